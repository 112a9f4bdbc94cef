"""Temporal list join against a loop over all captures and entries."""

import datetime
import random
from urllib.parse import urlsplit

from loomlake.llm.urlfilter import temporal_url_filter

CAPTURES = "page_id long, url string, fetched date"
ENTRIES = "pattern string, action string, day date"


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def patterns(url):
    parts = urlsplit(url or "")
    host = (parts.hostname or "").rstrip(".")
    if not host:
        return set()
    labels, folders = host.split("."), parts.path.split("/")
    return {host} | {".".join(labels[-k:]) for k in range(2, len(labels))} | {host + "/".join(folders[:k]) + "/" for k in range(2, len(folders))}


def brute(captures, entries):
    out = []
    for page, url, fetched in captures:
        active = []
        for p in patterns(url) if fetched else ():
            past = sorted({(d, a == "add") for q, a, d in entries if q == p and d is not None and d <= fetched})
            if past and all(listed for d, listed in past if d == past[-1][0]):
                active.append(p)
        out.append((page, url, fetched, len(active), min(active, default=None)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.example.org", "b.example.org", "example.org", "x.y.example.org", "other.net"]
    captures = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['', 'en/', 'en/a/b', 'de/x.html'])}", day(rng.randint(0, 30))) for i in range(150)]
    captures += [(200, None, day(3)), (201, "no url", day(3)), (202, captures[0][1], None), (0, *captures[0][1:]), (203, "http://user@A.Example.org:80/en/x", day(20))]
    entries = [(rng.choice([*hosts, "a.example.org/en/", "other.net/de/"]), rng.choice(["add", "add", "remove"]), day(rng.randint(0, 30))) for _ in range(40)]
    entries += [(None, "add", day(1)), ("example.org", "add", None), entries[0], ("other.net", "add", day(5)), ("other.net", "remove", day(5))]
    rows = temporal_url_filter(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()
    assert sorted(((r.page_id, r.url, r.fetched, r.n_active, r.listed_by) for r in rows), key=str) == brute(captures, entries)
    assert all(r.blocked == (r.n_active > 0) for r in rows) and any(r.blocked for r in rows)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], ENTRIES)
    captures = spark.createDataFrame([(1, "http://a.org/", day(0), 7, "mine", "kept")], CAPTURES + ", n_active int, Host string, extra string")
    row = temporal_url_filter(captures, none).first()
    assert (row.n_active, row.host, row.extra, row.blocked) == (0, "a.org", "kept", False)
    assert temporal_url_filter(captures.limit(0), none).count() == 0
