"""Named queries of the library and their SQL twins."""

from __future__ import annotations

from . import analytics, answers, documents, reports, requests

QUERIES: dict = {**documents.QUERIES, **analytics.QUERIES, **requests.QUERIES, **answers.QUERIES, **reports.QUERIES}
ORACLES: dict[str, str] = {**documents.ORACLES, **analytics.ORACLES, **requests.ORACLES, **answers.ORACLES, **reports.ORACLES}
