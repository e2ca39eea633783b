"""Spelling variants by pivotal grams against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import spelling as S
from ledgerlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def brute_counts(rows):
    low = {c: c + 32 for c in range(65, 91)}
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute(rows):
    n = brute_counts(rows)
    out, form = [], {}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = result(QUERIES["op12_pivotal_grams"](spark, SF001))
    want = brute(rows)
    assert got == want and sum(r[4] for r in want) > 100


def test_all_near_pairs_are_found(spark):
    """Few letters, so that bigrams tie and repeat and words are dense."""
    rng = random.Random(5)
    words = {"aaaaaaa", "aaaaaaaa", "abababab", "bababab"}
    while len(words) < 900:
        words.add("".join(rng.choice("abé") for _ in range(rng.randint(7, 9))))
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = {(r.word, r.other) for r in S.near_pairs(df).select("word", "other").collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 9)), min_size=3, max_size=9, unique_by=lambda g: g[0]))
def test_pivots_are_the_lightest_disjoint_pair(grams):
    grams.sort()
    weights = [w for _, w in grams]
    got = S.pivots(grams, weights)
    pairs = [(weights[i] + weights[j], [i, j]) for i in range(len(grams)) for j in range(i + 1, len(grams))
             if grams[j][0] >= grams[i][0] + 2]
    assert grams[got[1]][0] >= grams[got[0]][0] + 2
    assert sum(weights[i] for i in got) == min(w for w, _ in pairs)


def test_forms_chain_to_their_root(spark):
    words = ["abcdefg"] * 2 + ["abcdefgh"] * 20 + ["abcdefghi"] * 200 + ["abcdefghij"] * 2000 + ["unrelated"] * 5
    rows = [(i, w) for i, w in enumerate(words)]
    got = result(S.variant_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert len({r[2] for r in got if r[0].startswith("abcdefg") and len(r[0]) < 9}) >= 1


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(9)]
    got = S.roots(spark.createDataFrame(chain, "word string, form string"), 10 ** 9)
    assert {r.word: r.root for r in got.collect()} == {f"w{k}": "w9" for k in range(9)}
    with pytest.raises(ValueError):
        S.roots(spark.createDataFrame(chain, "word string, form string"), 10, ratio=1)


def test_edges(spark, monkeypatch):
    schema = "doc_id long, text string, word string, n long, gram string"
    empty = S.variant_groups(spark.createDataFrame([], schema))
    assert empty.count() == 0
    monkeypatch.setattr(S, "SLICE_BYTES", 64)
    rows = [(1, None), (2, ""), (None, "Straßenbahn straßenbahn STRASSENBAHN strasenbahn strasenbahn"),
            (None, "×÷×÷×÷×÷ ×÷×÷×÷×÷ Àéîõü àéîõü"), (3, "zzzzzzz " * 4000 + "." * 500 + "zzzzzzzz " * 300),
            (4, "ünterıschied ÜBERMUT übermut"), (4, "ünterıschied ÜBERMUT übermut"), (5, "абв " * 60 + "wordword wordword")]
    df = spark.createDataFrame([(*r, "x", 1, "g") for r in rows], schema)
    assert result(S.variant_groups(df)) == brute(rows)
    with pytest.raises(ValueError):
        S.near_pairs(spark.createDataFrame([("abc", 2)], "word string, n long"), min_chars=3)


def test_slices_never_cut_a_run():
    data = b"abc def,ghi " * 50
    for size in (1, 5, 17):
        parts = list(S.slices(data, S._BLANK, size))
        assert b"".join(parts) == data and [r for p in parts for r in S._RUN.findall(p)] == S._RUN.findall(data)
