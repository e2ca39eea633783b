"""Temporal list join against a scan of all entries, and its SQL."""

import duckdb
import random

import __spark_entry__ as entry
from ledgerlens.llm import url_lists as u
from ledgerlens.llm.queries import op1_tables

SF01 = "/root/testdata/sf0.01"


def test_query_matches_sql_and_both_outcomes_occur(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF01}/pages.parquet'")
    rel = con.execute(entry.oracle_sql()["op1_temporal_url_lists"])
    cols = [d[0] for d in rel.description]
    got = entry.queries()["op1_temporal_url_lists"](spark, SF01)
    assert sorted(cols) == sorted(got.columns)
    rows = got.select(*cols).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(rel.fetchall(), key=repr)
    assert {r.blocked for r in rows} == {True, False}
    assert {r.kind for r in rows} >= {"host", "domain", "prefix", None}
    assert any(not r.blocked and r.kind for r in rows)  # an allowing entry decided
    captures, entries = op1_tables(spark, SF01)
    assert {r.action for r in entries.collect()} == {"block", "allow", "remove"}
    blocked = {r.page_id for r in rows if r.blocked}
    assert {r.page_id for r in u.keep_allowed(captures, entries).collect()} == {r.page_id for r in rows} - blocked


def brute(captures, entries):
    """Replays the log of each key up to the fetch time."""
    out = {}
    log = {}
    for lst, kind, key, action, at in entries:
        log.setdefault((lst, kind, key), {}).setdefault(at, set()).add(action)
    for page, url, t in captures:
        best = None
        if url and t is not None and "://" in url:
            scheme, rest = url.split("://", 1)
            rest = rest.split("#")[0]
            end = min([rest.find(c) for c in "/?" if c in rest] or [len(rest)])
            host = rest[:end].rsplit("@")[-1].rsplit(":", 1)[0].lower()
            path = rest[end:].split("?")[0]
            norm = f"{scheme.lower()}://{host}{rest[end:]}"
            for (lst, kind, key), changes in log.items():
                past = [a for a in changes if a <= t]
                action = max(changes[max(past)]) if past else "remove"
                fits = {"url": norm == key, "host": host == key, "domain": host == key or host.endswith("." + key),
                        "prefix": key.endswith("/") and (host + path).startswith(key)}[kind]
                if host and fits and action != "remove":
                    best = min(filter(None, [best, (u.KINDS.index(kind), -len(key), lst, action, kind, key, max(past))]))
        out[page, url, t] = best
    return out


def test_random_logs(spark):
    rng = random.Random(1)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "EXAMPLE.com:80", "u@x.org"]
    paths = ["", "/", "/p", "/p/", "/p/q", "/p/q/r.html?x=1#f", "/p?y", "#z"]
    captures = [(i, "hTTp://" + rng.choice(hosts) + rng.choice(paths), rng.randrange(0, 400)) for i in range(400)]
    captures += [(900, None, 5), (901, "no url", 5), (902, "http://x.org/", None), (None, "http://x.org/", 7)]
    keys = [("host", "a.example.com"), ("domain", "example.com"), ("domain", "com"), ("prefix", "x.org/"),
            ("prefix", "example.com/p/"), ("prefix", "a.example.com/p/q/"), ("url", "http://x.org/p/q/r.html?x=1"),
            ("url", "http://example.com/p"), ("host", "x.org")]
    entries = [(rng.choice("mn"), *rng.choice(keys), rng.choice(["block", "allow", "remove"]), rng.randrange(0, 400))
               for _ in range(90)]
    want = brute(captures, entries)
    df = spark.createDataFrame(captures * 2, "page_id long, url string, fetched_at long")
    log = spark.createDataFrame(entries + [(None, "host", "x.org", "block", 0), ("m", "regex", "x", "block", 0)],
                                "list string, kind string, key string, action string, effective long")
    got = u.judge(df, log, bucket=37, salts=3).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.page_id, r.url, r.fetched_at]
        assert r.blocked == (w is not None and w[3] == "block")
        assert (r.list, r.kind, r.key, r.valid_from) == ((w[2], w[4], w[5], w[6]) if w else (None,) * 4)


def test_edges(spark):
    schema = "page_id long, url string, fetched_at long, list string, m int, _bucket int"
    log_schema = "list string, kind string, key string, action string, effective long, note string"
    none = spark.createDataFrame([], log_schema)
    log = spark.createDataFrame([("l", "host", "h", "block", 10, "n"), ("l", "host", "h", "block", 10, "n"),
                                 ("l", "host", "h", "allow", 10, "n"), ("l", "host", "h", "remove", 20, "n")], log_schema)
    empty = spark.createDataFrame([], schema)
    assert u.judge(empty, log).count() == 0
    long = "http://h/" + "a/" * 30_000
    df = spark.createDataFrame([(1, "http://h/", 10, "x", 1, 1), (1, "http://h/", 10, "y", 2, 2), (2, "http://h/", 9, "", 1, 1),
                                (3, "http://h/", 20, "", 1, 1), (4, long, 19, "", 1, 1)], schema)
    got = {r.page_id: r.blocked for r in u.judge(df, log).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}
    assert {r.blocked for r in u.judge(df, none).collect()} == {False}
    kept = u.keep_allowed(df, log)
    assert kept.columns == df.columns and sorted(r.page_id for r in kept.collect()) == [2, 3]
