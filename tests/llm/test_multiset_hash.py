"""Multiset fingerprints against a plain sum of paragraph vectors."""

import hashlib
import random

import numpy as np
import pytest

from ledgerlens.llm import multiset_hash as M
from ledgerlens.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def plain(text):
    """A fingerprint as the sum of single paragraphs', over Python integers."""
    wide, near = [0] * M.WIDE, [0] * M.NEAR
    for p in (text or "").split("\n"):
        one = M.Fingerprint.of([p])
        wide = [(a + int(b)) % 2 ** 64 for a, b in zip(wide, one.wide)]
        near = [(a + int(b) + 2 ** 15) % 2 ** 16 - 2 ** 15 for a, b in zip(near, one.near)]
    return M.Fingerprint(np.array(wide, np.uint64), np.array(near, np.int16)).encode()


def brute(rows):
    """All documents in order of their ids, one after the other."""
    rows = sorted((i, t or "") for i, t in rows)
    out = []
    for at, (i, t) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        q = len(t) // 4
        new = t[:len(t) - q] + following[:q]
        mine, other, after = (M.Fingerprint.decode(plain(x)) for x in (t, new, following))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), mine.encode(), other.encode(),
                    mine.likeness(other), mine.likeness(after)))
    return out


COLS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    got = QUERIES["op11_multiset_hash"](spark, SF01).select(*COLS).collect()
    assert sorted(tuple(r) for r in got) == brute(docs)
    texts = dict(docs)
    by_print = {}
    for r in got:
        by_print.setdefault(r.fingerprint, set()).add(tuple(sorted(texts[r.doc_id].split("\n"))))
    assert all(len(s) == 1 for s in by_print.values()) and len(by_print) == len(set(map(
        lambda t: tuple(sorted(t.split("\n"))), texts.values())))
    # the likeness tells the edited text from the next one
    long = [r for r in got if r.n_chars >= 200]
    assert np.mean([r.near_edited > 0.5 for r in long]) > 0.97
    assert np.mean([r.near_next < 0.3 for r in long]) > 0.95
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.99


def test_likeness_estimates_the_share_of_common_pairs():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    text = [rng.choice(words) for _ in range(2000)]
    for share in (0.0, 0.25, 0.5, 0.9):
        k = int(len(text) * share)
        other = text[:k] + [rng.choice(words) for _ in range(len(text) - k)]
        got = M.Fingerprint.of([" ".join(text)]).likeness(M.Fingerprint.of([" ".join(other)]))
        assert abs(got - share) < 0.2


def test_order_insertion_and_deletion():
    a, b, c = "one two three", "four five", "six"
    whole = M.Fingerprint.of([a, b, c])
    assert whole == M.Fingerprint.of([c, a, b]) and whole.likeness(M.Fingerprint.of([c, b, a])) == 1.0
    assert whole - M.Fingerprint.of([b]) == M.Fingerprint.of([a, c])
    assert M.Fingerprint.of([a]) + M.Fingerprint.of([b, c]) == whole
    assert M.Fingerprint.of([a, a]) != M.Fingerprint.of([a])
    assert M.Fingerprint.decode(whole.encode()) == whole


def test_update_equals_fingerprints_of_the_changed_texts(spark):
    docs = spark.createDataFrame([(1, "a b\nc d"), (2, None), (None, "x\ny")], "doc_id long, text string")
    edits = spark.createDataFrame(
        [(1, "c d", -1), (1, "new line", 2), (2, "z z z", 1), (None, "y", -1), (7, "only edits", 1), (1, "q", None)]
        + [(2, "hot", 1)] * 3000, "doc_id long, paragraph string, count int")
    got = {r.doc_id: r.fingerprint for r in M.update(M.fingerprints(docs), edits).collect()}
    assert got == {1: plain("a b\nnew line\nnew line"), 2: plain("\n".join(["", "z z z"] + ["hot"] * 3000)),
                   None: plain("x"), 7: plain("only edits")}


def test_a_repeated_pair_wraps_without_harm_to_equality():
    many = M.Fingerprint.of(["a b " * 40_000])
    assert many == M.Fingerprint.of(["a b " * 40_000]) and many != M.Fingerprint.of(["a b " * 39_999])
    assert 0.0 <= many.likeness(M.Fingerprint.of(["a b " * 39_999])) <= 1.0


@pytest.mark.parametrize("partitions", [1, 5])
def test_edges(spark, partitions):
    schema = "doc_id long, text string, at int, copy int, none int, h int, fingerprint string"
    empty = M.edited_fingerprints(spark.createDataFrame([], schema))
    assert empty.columns == COLS and empty.count() == 0
    assert M.fingerprints(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 60_000 + "\n" + "x" * 50_000
    rows = [(5, long), (3, None), (4, ""), (9, "abcdefgh"), (9, "abcdefgh"), (8, "añb\n" * 7), (-2, " \n "), (10, "\n\n")]
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, "") for r in rows], schema).repartition(partitions)
    got = M.edited_fingerprints(df)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    one = M.edited_fingerprints(df.where("doc_id = 5")).collect()
    assert [tuple(r) for r in one] == brute([(5, long)])


def test_null_and_repeated_ids(spark):
    """Null ids come last; rows of one id in any fixed order; one row each."""
    rows = [(None, "p q r s t u"), (None, "v w"), (1, "first text here"), (1, "other text"), (1, "other text")]
    got = M.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted(
        (i is None, i or 0, plain(t)) for i, t in rows)
    prints = {plain(t): t for _, t in rows}
    for r in got:  # the edited text is that of some other row, or of an equal one
        t = prints[r.fingerprint]
        q = len(t) // 4
        assert r.edited_sha256 in {hashlib.sha256((t[:len(t) - q] + o[:q]).encode()).hexdigest() for o in prints.values()}
    words = [("b", "ab cd ef gh"), ("a", "ij kl mn op"), (None, "zz")]
    by_name = M.edited_fingerprints(spark.createDataFrame(words, "name string, body string"), id_col="name", text_col="body")
    assert {r.doc_id: r.edited_sha256 for r in by_name.collect()} == {
        "a": hashlib.sha256(b"ij kl mn ab").hexdigest(), "b": hashlib.sha256(b"ab cd ef zz").hexdigest(),
        None: hashlib.sha256(b"zz").hexdigest()}
