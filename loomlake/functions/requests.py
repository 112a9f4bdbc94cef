"""Expressions over requests and uploads: client keys, file names, verdicts, log levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEGABYTE = 1024 * 1024


def client_key(forwarded: Column, real: Column, peer: Column) -> Column:
    """The first forwarded address, else the real one, else the peer, else 'unknown'. Empty values count as missing."""
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(full(F.split_part(forwarded, F.lit(","), F.lit(1))), full(real), full(peer), F.lit("unknown"))


def safe_filename(name: Column) -> Column:
    """The name without path separators and leading dots or blanks; unsafe ASCII becomes '_', an empty name 'unnamed'."""
    kept = F.regexp_replace(F.regexp_replace(name, r"[/\\]", ""), r"[^A-Za-z0-9._\- \x{80}-\x{10FFFF}]", "_")
    kept = F.regexp_replace(kept, "^[. ]+", "")
    return F.when(F.coalesce(kept, F.lit("")) == "", "unnamed").otherwise(kept)


def upload_verdict(name: Column, size: Column, extensions: set[str] | None, most: int) -> Column:
    """Why an upload is refused, or that it passed. A null size counts as 0."""
    found = F.lower(F.regexp_extract(name, r"[^./\\](\.[^./\\]+)$", 1))
    verdict = F.when(F.coalesce(name, F.lit("")) == "", "Empty filename")
    said = F.format_string(f"File size %.2fMB exceeds maximum {most / MEGABYTE:.2f}MB", size / F.lit(float(MEGABYTE)))
    verdict = verdict.when(size > most, said)
    if extensions is not None:
        verdict = verdict.when(~found.isin(*sorted(extensions)), F.concat(F.lit("File extension '"), found, F.lit("' not allowed")))
    return verdict.otherwise("Upload validation passed")


def speed_class(milliseconds: Column) -> Column:
    return F.when(milliseconds < 100, "fast").when(milliseconds < 500, "normal").when(milliseconds < 1000, "slow").when(milliseconds.isNotNull(), "very_slow")


def log_level(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warning").otherwise("info")
