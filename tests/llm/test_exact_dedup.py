"""Bloom-filtered exact dedup against a dictionary of normalised texts."""

import hashlib
import re

import numpy as np

from ledgerlens.llm import exact_dedup
from ledgerlens.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return sorted((i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
                  for t, ids in groups.items() for i in ids)


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    got = QUERIES["op9_exact_dedup"](spark, SF01)
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == brute(docs)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """Many more rows than the filter holds: all rows take the exact way."""
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda n: 64)
    rows = [(i, f"t{i % 400}") for i in range(600)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == brute(rows)


def test_unique_rows_pass_straight(spark):
    rows = [(i, f"t{i}") for i in range(500)] + [(500, "t3")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed, bitmap, bits = exact_dedup._hashed(df, "doc_id", "text")
    tested, _ = exact_dedup._groups(hashed, bitmap, bits)
    flagged = {r.doc_id for r in tested.where("_maybe").collect()}
    assert {3, 500} <= flagged and len(flagged) < 10
    assert np.unpackbits(bitmap).sum() >= 1


def test_edges_and_drop(spark):
    schema = "doc_id long, text string, keep_id string, _sha int, _maybe int"
    empty = spark.createDataFrame([], schema)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).columns == empty.columns
    long = "a b " * 50_000
    rows = [(4, long, "k", 1, 2), (3, long.replace(" ", "\t\n"), "k", 1, 2), (7, None, "", 0, 0), (6, "", "", 0, 0),
            (6, "", "", 0, 0), (None, "", "", 0, 0), (9, "u\u00a0v", "z", 3, 4), (1, "u v", "z", 3, 4)]
    df = spark.createDataFrame(rows, schema)
    got = exact_dedup.exact_groups(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got if r.kept) == [
        (1, 1, 1), (3, 3, 2), (6, 6, 4), (9, 9, 1)]
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 9]
