"""Collocations against plain counting, and the summaries' guarantee."""

import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import collocations as C
from ledgerlens.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def brute(rows, least=10, top=2000):
    low = {c: c + 32 for c in range(65, 91)}
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = {}
    for (lang, w), a in cand.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                inside[lang, part] = max(a, inside.get((lang, part), 0))
    lists = {}
    for (lang, w), a in cand.items():
        if 100 * inside.get((lang, w), 0) >= 50 * a:
            continue
        s, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        lists.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, k + 1, p.decode(), -a, x, y, n[lang], -s)
                  for lang, found in lists.items() for k, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_query_matches_brute_force(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    want = brute(rows)
    assert result(QUERIES["op13_misra_gries"](spark, SF01)) == want and len(want) > 500


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(1, 30), min_size=1, max_size=30), min_size=1, max_size=12),
       st.integers(2, 25))
def test_no_frequent_key_is_lost(parts, least):
    """Whatever is merged in whatever order, within the capacity."""
    total = Counter()
    mass = sum(sum(p.values()) for p in parts)
    summary = C.MisraGries(mass // least + 1)
    for p in parts:
        total.update(p)
        summary.merge(np.fromiter(p.keys(), np.uint64), np.fromiter(p.values(), np.int64))
        assert len(summary.keys) <= summary.capacity
    kept = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert summary.error < least
    for k, n in total.items():
        assert kept.get(k, 0) <= n <= kept.get(k, 0) + summary.error
        assert n < least or kept[k] + summary.error >= least


def test_summaries_really_subtract(spark):
    """Mostly rare phrases: counters run out, frequent ones survive."""
    rng = random.Random(2)
    rows = [("x", " ".join([f"r{rng.randrange(10 ** 6)}" for _ in range(200)] + ["new york"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "lang string, text string")
    found = C.survivors(df, 10).count()
    assert 3 <= found < 400 * 200 * 3 / 10
    assert [r[2:5] for r in result(C.collocations(df))] == [("new york", 400, 400)]


def test_slices_join_up(spark, monkeypatch):
    """Slices of a few words, vocabularies of a few words, texts in parts."""
    rows = [(lang, r.text) for lang, r in zip("ababc" * 8, spark.read.parquet(f"{SF01}/documents.parquet").limit(40).collect())]

    def held(ids_langs):
        import pyarrow as pa
        batches = [pa.RecordBatch.from_pylist([{"lang": a, "text": b} for a, b in ids_langs[k:k + 7]],
                                              pa.schema([("lang", pa.string()), ("text", pa.string())]))
                   for k in range(0, len(ids_langs), 7)]
        slices, out, n = C._Slices(iter(batches)), Counter(), Counter()
        for ids, langs, again in slices:
            names = list(slices.langs)
            n.update(names[x] for x, i in zip(langs[again:].tolist(), ids[again:].tolist()) if i)
            for k, first, h in C._phrases(slices, ids, langs, again):
                for p in first.tolist():
                    out[names[langs[p]], b" ".join(slices.words.words[i] for i in ids[p:p + k]).decode()] += 1
        return out, n

    whole = held(rows)
    monkeypatch.setattr(C, "SLICE_WORDS", 50)
    monkeypatch.setattr(C, "MEMO_WORDS", 20)
    monkeypatch.setattr(C, "SLICE_BYTES", 64)
    assert held(rows) == whole


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").limit(120).collect()]
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(C, "MIN_BITS", 64)
    monkeypatch.setattr(C, "MAX_BITS", 64)
    assert result(C.collocations(df)) == brute(rows)


def test_edges(spark):
    schema = "lang string, text string, phrase string, words int, f long, score string"
    empty = C.collocations(spark.createDataFrame([], schema))
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and empty.count() == 0
    rows = ([(None, "New York"), ("und", "new  york"), ("en", "new york")] * 6 + [("en", None), ("de", ""), ("fr", ". ,")]
            + [("en", "a a a a a a a a a a a a a"), ("en", "x y\nz " * 30), ("é", "ü b  c É e\x1fe " * 12)]
            + [("long", "the quick. brown fox " * 60_000)])
    df = spark.createDataFrame([(*r, "p", 1, 2, "s") for r in rows], schema)
    assert result(C.collocations(df)) == brute(rows)


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of 5 * 10**11: a * a * 10**6 needs 98 bits."""
    big = 5 * 10 ** 11
    table = spark.createDataFrame(
        [("x", "a b", 2, big - 1), ("x", "a", 1, big), ("x", "b", 1, 2 * big), ("x", None, 0, 9 * big)],
        "lang string, phrase string, words int, f long")
    monkeypatch.setattr(C, "frequent_phrases", lambda *a, **k: table)
    assert result(C.collocations(table)) == [
        ("x", 1, "a b", big - 1, big, 2 * big, 9 * big, 10 ** 6 * (big - 1) ** 2 // (2 * big * big))]
