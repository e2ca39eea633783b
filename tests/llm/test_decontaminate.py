"""Latent retrieval: against word-by-word search, exact SVD and exact LCS."""

import random

import numpy as np
import pytest

from ledgerlens.llm import decontaminate as d
from ledgerlens.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def test_query_finds_every_whole_item_and_nothing_else(spark):
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op6_latent_decontamination"](spark, SF01).collect()}
    docs = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    items = [(r.item_id, " ".join(d.words(r.text))) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    want = {(x.doc_id, i) for x in docs for i, t in items if f" {t} " in f" {' '.join(d.words(x.text))} "}
    assert want and want <= got.keys()
    # anything further must share nearly all of an item by an exact LCS
    text = {x.doc_id: d.words(x.text) for x in docs}
    for (doc, item), r in got.items():
        if (doc, item) not in want:
            assert lcs(d.words(dict(items)[item]), text[doc]) >= 0.6 * len(d.words(dict(items)[item]))
    assert len(got.keys() - want) <= 0.02 * len(want) + 1


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_bit_subsequence_equals_table():
    rng = random.Random(0)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 90))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 90))]
        assert d.common_subsequence(d._masks(a), len(a), b) == lcs(a, b)


def _dense(matrix, terms):
    out = np.zeros((len(matrix.starts), terms))
    ends = [*matrix.starts[1:], len(matrix.terms)]
    for r, (a, b) in enumerate(zip(matrix.starts, ends)):
        out[r, matrix.terms[a:b]] = matrix.weights[a:b]
    return out


def test_passages_are_overlapping_windows():
    rng, terms = np.random.default_rng(1), 40
    idf = np.where(np.arange(terms) % 3 == 0, 0.0, np.arange(terms) + 1.0)
    seqs = [rng.integers(0, terms, n) for n in (0, 5, 32, 33, 64, 65, 200, 1)]
    got = d.passages(seqs, idf)
    want = []
    for i, s in enumerate(seqs):
        halves = -(-len(s) // d.HALF)
        for h in range(max(1, halves - 1) if halves else 0):
            t, c = np.unique([w for w in s[h * d.HALF:(h + 2) * d.HALF] if idf[w] > 0], return_counts=True)
            if len(t):
                row = np.zeros(terms)
                row[t.astype(int)] = (1 + np.log(c)) * idf[t.astype(int)]
                want.append((i, h, row))
    assert got.sequence.tolist() == [w[0] for w in want] and got.half.tolist() == [w[1] for w in want]
    assert np.allclose(_dense(got, terms), [w[2] for w in want], rtol=1e-5)
    counts, halves = d.half_frequencies(seqs, terms)
    assert halves == sum(-(-len(s) // d.HALF) for s in seqs)
    assert counts[7] == sum(7 in s[i:i + d.HALF] for s in seqs for i in range(0, len(s), d.HALF))


def test_distributed_svd_equals_numpy(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(vocabulary[5 * (i % 5):5 * (i % 5) + 8], 70))) for i in range(60)]
    items = d.Items.of([(1, " ".join(vocabulary)), (2, "w1 w2 w3 w4 w5 w6 w7")])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    seqs = d.numbered(df, items, "doc_id", "text")
    space = d.fit(seqs, items, rank=30)
    numbers = [np.array([items.vocabulary[w] for w in t.split()]) for _, t in docs]
    a = np.vstack([_dense(d.passages(numbers, space.idf), 31), _dense(d._item_passages(items, space.idf)[0], 31)])
    want = np.linalg.svd(a, compute_uv=False)
    k = min(len(space.values), np.sum(want > 1e-3 * want[0]))
    assert np.allclose(space.values[:k], want[:k], rtol=1e-3)
    assert np.allclose(a @ space.vectors @ space.vectors.T, a, atol=1e-2 * np.abs(a).max())


def test_paraphrases_need_the_answer(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(4000)]
    item = [rng.choice(vocabulary) for _ in range(30)]
    question, answer = item[:22], item[22:]
    text = " ".join(question) + ". " + " ".join(answer) + "."

    def around(words):
        noise = lambda: [rng.choice(vocabulary) for _ in range(150)]
        return " ".join([*noise(), *words, *noise()])

    edited = [w if i % 3 else "other" for i, w in enumerate(question)]
    rows = [(1, around(item)), (2, around([*edited, *answer])),
            (3, around([*edited, *answer[:4], "no", *answer[5:]])), (4, around(item[:12])), (5, around([]))]
    rows += [(i, around([])) for i in range(6, 60)]
    rows[0] = (1, rows[0][1].upper().replace(" ", ",  "))
    bench = spark.createDataFrame([(7, text), (8, "\n" + text), (9, None), (None, "x"), (10, " ... ")],
                                  "item_id long, text string")
    got = d.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.kind) for r in got) == [
        (1, 7, "near"), (1, 8, "near"), (2, 7, "paraphrase"), (2, 8, "paraphrase")]


def _around(rng, vocabulary, words):
    noise = lambda: [rng.choice(vocabulary) for _ in range(150)]
    return " ".join([*noise(), *words, *noise()])


def test_every_item_has_an_answer_that_a_paraphrase_can_hold(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(4000)]
    a, b, c = ([rng.choice(vocabulary) for _ in range(30)] for _ in range(3))
    end = lambda w: " ".join(w) + ". "
    bench = [(1, end(a[:20]) + end(a[20:28]) + end(a[28:])),  # a last sentence of two words
             (2, end(b)),  # one sentence
             (3, end(c[:29]) + end(c[29:]))]  # one word behind nearly all
    edit = lambda w: [x if i % 3 else "other" for i, x in enumerate(w)]
    rows = [(1, [*edit(a[:20]), *a[20:]]), (2, [*edit(b[:22]), *b[22:]]), (3, [*edit(c[:22]), *c[22:]]),
            (4, [*edit(a[:20]), *a[20:26], "no", *a[27:]]), (5, [*edit(b[:22]), *b[22:28], "no", b[29]]), (6, [])]
    rows = [(i, _around(rng, vocabulary, w)) for i, w in rows] + [(i, _around(rng, vocabulary, [])) for i in range(7, 60)]
    got = d.contaminated(spark.createDataFrame(rows, "doc_id long, text string"),
                         spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.kind) for r in got) == [(i, i, "paraphrase") for i in (1, 2, 3)]
    for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect():
        n = len(d.words(r.text))
        assert d.ANSWER <= d.answer_words(r.text) < d.NEAR * n


def test_items_with_words_put_in_between(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(4000)]
    item = rng.sample(vocabulary, 40)

    def spread(every):  # a further word behind every so many tenths of a word
        out, left = [], 0
        for w in item:
            out.append(w)
            left += every
            while left >= 10:
                out.append("further")
                left -= 10
        return out

    rows = [(i, _around(rng, vocabulary, spread(e))) for i, e in enumerate([0, 5, 6, 10, 13, 20])]
    rows += [(i, _around(rng, vocabulary, [])) for i in range(6, 60)]
    got = d.contaminated(spark.createDataFrame(rows, "doc_id long, text string"),
                         spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.kind) for r in got) == [(i, "near") for i in range(5)]


def test_items_without_an_id_are_searched(spark):
    docs = spark.createDataFrame([(1, "so alpha beta gamma it is"), (2, "delta epsilon too, alpha beta gamma"),
                                  (3, "one two three"), (4, "no item")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "Alpha beta gamma."), (None, "delta epsilon"), (5, "One two."), (None, None)],
                                  "item_id long, text string")
    got = d.contaminated(docs, bench)
    assert sorted((r.doc_id, r.item_id, r.kind) for r in got.collect()) == [(1, None, "exact"), (2, None, "exact"), (3, 5, "exact")]
    assert got.schema["item_id"].dataType.simpleString() == "bigint"
    assert [r.doc_id for r in d.drop_contaminated(docs, bench).collect()] == [4]
    big = d.contaminated(docs.coalesce(1), spark.createDataFrame([(None, "no item"), (2**60 + 1, "one two")], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in big.collect()) == [(3, 2**60 + 1), (4, None)]


def test_two_thousand_items_are_found_nearly_as_by_brute_force(spark):
    """Edited and verbatim copies, and an item in a third of the documents.
    Retrieval is latent, so its recall is measured: against what was planted,
    and against the exact reference, all pairs that share enough words."""
    rng = random.Random(8)
    texts = [r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").orderBy("doc_id").collect() if d.words(r.text)]
    long = [t for t in map(d.words, texts[600:]) if len(t) > 100]
    bench = [r.text for r in spark.read.parquet(f"{SF01}/benchmark.parquet").orderBy("item_id").collect()]
    while len(bench) < 2000:
        source, n = rng.choice(long), rng.randrange(15, 60)
        at = rng.randrange(len(source) - n)
        bench.append(" ".join(source[at:at + n]))
    items = d.Items.of(list(enumerate(bench)))
    docs, planted = [], set()
    for i, text in enumerate(texts[:600]):
        found = d.words(text)
        end = len(found)  # the next copy stands before the last one
        put = [(d.words(bench[j]), j) for j in ([7] if i % 3 == 0 else []) + [100 + 3 * i]]
        for copy, j in put:
            if i % 2 and j != 7:  # words before the answer are replaced, as many as a paraphrase may lose
                n, kept = len(copy), len(items.answers[j])
                for at in rng.sample(range(n - kept), int(0.38 * n)):
                    copy[at] = "replaced"
            end = rng.randrange(end + 1)
            found[end:end] = copy
            planted.add((i, j))
        docs.append((i, found))
    got = {(r.doc_id, r.item_id) for r in d.contaminated(
        spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(8),
        spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")).collect()}
    assert len(planted & got) >= 0.995 * len(planted), (len(planted - got), len(planted))
    # every pair that shares enough words at all, checked over the whole document
    checker, padded = d.Checker(items), np.zeros((len(bench), 60), np.int64)
    for j, s in enumerate(items.sequences):
        padded[j, :len(s)] = s
    need = 0.6 * np.array([len(s) for s in items.sequences])
    exact = set()
    for i, found in docs[::4]:
        numbers, here = [items.vocabulary.get(w, 0) for w in found], np.zeros(len(items.vocabulary) + 1, bool)
        here[numbers] = True
        here[0] = False
        for j in np.flatnonzero(here[padded].sum(1) >= need).tolist():
            if checker.check(j, numbers):
                exact.add((i, j))
    assert len(exact & got) >= 0.97 * len(exact), (len(exact - got), len(exact))


def test_blocks_of_items_find_the_same(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    one = {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()}
    three = {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench, block_items=15).collect()}
    assert one == three


def test_edges(spark):
    schema = "doc_id long, text string, item_id string, s int, kind int"
    bench = spark.createDataFrame([(1, "Alpha beta, gamma."), (2, " ".join(f"t{i}" for i in range(300)))],
                                  "item_id long, text string")
    empty = spark.createDataFrame([], schema)
    assert d.contaminated(empty, bench).count() == 0
    long = " ".join(f"x{i % 5000}" for i in range(50_000)) + " alpha beta gamma " + "x " * 90 + " ".join(f"t{i}" for i in range(300))
    rows = [(1, None, "", 1, 1), (2, "", "", 1, 1), (3, "?!", "", 1, 1), (4, "ALPHA  beta gamma!", "", 1, 1),
            (4, "ALPHA  beta gamma!", "", 1, 1), (5, "alpha gamma beta", "", 1, 1), (6, long, "", 1, 1),
            (None, "alpha", "", 1, 1)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id, r.item_id) for r in d.contaminated(df, bench).collect())
    assert got == [(4, 1), (6, 1), (6, 2)]
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 5, None], key=repr)
    assert d.contaminated(df, bench.where("false")).count() == 0
    with pytest.raises(Exception):
        d.contaminated(df.drop("text"), bench)


def _corpus(spark, n_items, n_docs=400, seed=11):
    """Documents with planted copies of spans that serve as items."""
    rng = random.Random(seed)
    texts = [r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").orderBy("doc_id").collect() if d.words(r.text)]
    long = [t for t in map(d.words, texts[n_docs:]) if len(t) > 100]
    bench = []
    for _ in range(n_items):
        source, n = rng.choice(long), rng.randrange(15, 60)
        at = rng.randrange(len(source) - n)
        bench.append(" ".join(source[at:at + n]))
    docs, planted = [], set()
    for i, text in enumerate(texts[:n_docs]):
        found, j = d.words(text), rng.randrange(n_items)
        at = rng.randrange(len(found) + 1)
        found[at:at] = d.words(bench[j])
        docs.append((i, " ".join(found)))
        planted.add((i, j))
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(6),
            spark.createDataFrame(list(enumerate(bench)), "item_id long, text string"), planted)


def test_the_latent_search_does_the_retrieving(spark):
    docs, bench, planted = _corpus(spark, 200)
    pairs = lambda **kw: {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench, **kw).collect()}
    both, latent, none = pairs(), pairs(kept=0.0), pairs(cosine=9.0)
    assert len(planted & both) >= 0.995 * len(planted) and len(planted & latent) >= 0.95 * len(planted)
    assert len(planted & none) < 0.5 * len(planted)
    # the exact reference: every item by its rarest words
    assert both <= (exact := pairs(kept=9.0)) and len(both) >= 0.99 * len(exact) and planted <= exact


def test_the_window_with_the_answer_counts():
    words = [f"w{i}" for i in range(40)]
    item = d.Items.of([(1, " ".join(words[:30]) + ". " + " ".join(words[30:]))])
    number = lambda ws: [item.vocabulary.get(w, 0) for w in ws]
    assert len(item.answers[0]) == 10
    better = words[:30]  # 30 of 40 words, without the answer
    answered = words[:15] + ["no"] * 15 + words[30:]
    check = d.Checker(item).check
    assert check(0, number(better)) is None
    assert check(0, number(answered)) == check(0, number(better + ["x"] * 100 + answered)) == (0.625, "paraphrase")
    assert check(0, number(answered + ["x"] * 100 + words)) == (1.0, "near")
    assert check(0, []) is None


def test_candidates_that_overlap_are_one():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(0, 40))
        begin = rng.integers(0, 60, n)
        pairs = np.stack([rng.integers(0, 3, n), rng.integers(0, 3, n), begin, begin + rng.integers(1, 20, n)], 1)
        cosines = rng.random(n)
        got = list(d._joined_candidates(pairs, cosines))
        for i, item in {tuple(p[:2]) for p in pairs.tolist()}:
            mine = (pairs[:, 0] == i) & (pairs[:, 1] == item)
            covered = {x for a, b in pairs[mine][:, 2:].tolist() for x in range(2 * a, 2 * b + 1)}
            spans = [g for g in got if g[:2] == (i, item)]
            assert {x for g in spans for x in range(2 * g[2], 2 * g[3] + 1)} == covered
            assert sum(2 * (g[3] - g[2]) + 1 for g in spans) == len(covered)
            assert max(g[4] for g in spans) == cosines[mine].max()


def test_rows_go_for_their_own_text(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, "so " + item + " it is", 0, "a"), (1, "another text of the same id", 0, "b"), (None, item, 0, "c"),
            (None, "clean", 0, "d"), (2, "clean", 0, "e"), (2, None, 0, "f"), (2, "clean", 0, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _out int, _md5 string")
    bench = spark.createDataFrame([("x", item), (None, "nothing like it here at all, no")], "item_id string, text string")
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r._md5 for r in kept.collect()) == ["b", "d", "e", "e", "f"]
    got = d.contaminated(docs, bench)
    assert got.schema["item_id"].dataType.simpleString() == "string"
    assert sorted((r.doc_id or 0, r.item_id, r.kind) for r in got.collect()) == [(0, "x", "near"), (1, "x", "near")]


def test_items_of_one_id_are_dealt_to_blocks(spark):
    texts = [" ".join(f"u{i}x{k}" for k in range(12)) for i in range(40)]
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, t) for t in texts] + [(None, texts[0])] * 50, "item_id long, text string")
    got = d.contaminated(docs, bench, block_items=10)
    assert sorted(r.doc_id for r in got.collect()) == list(range(40))
