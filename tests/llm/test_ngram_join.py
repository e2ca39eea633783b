"""Prefix-tree join against all pairs; components against union-find."""

import itertools
import random
import re

import numpy as np
import pytest

from ledgerlens.llm import ngram_join
from ledgerlens.llm.components import components
from ledgerlens.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def linked(x, y):
    i = len(x & y)
    return bool(x and y) and 100 * i >= 85 * (len(x) + len(y) - i)


def brute(rows):
    """Links by all pairs that share a gram, components by union-find."""
    sets = [grams(t) for _, t in rows]
    index, parent, links = {}, list(range(len(rows))), set()

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in index.get(g, ())}:
            if linked(s, sets[j]):
                links.add((j, i))
                parent[find(i)] = find(j)
        for g in s:
            index.setdefault(g, []).append(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    best = {r: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for r, m in groups.items()}
    return [(d, len(sets[i]), best[find(i)]) for i, (d, _) in enumerate(rows)], links, sets


def near_copies(rng, families=12, most=40):
    """Families of copies with random edits, over shared passages."""
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(3)]
    out = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120, 400]))]
        if f % 3 == 0:
            base = base + passages[f % 2] + passages[2]
        for _ in range(rng.randrange(1, most)):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(words) // 40) + 1)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    got = QUERIES["op8_prefix_tree_join"](spark, SF01).select("doc_id", "n_shingles", "component_id").collect()
    want, links, _ = brute(docs)
    assert sorted(map(tuple, got)) == sorted(want) and links


@pytest.mark.parametrize("seed,block,rare,batch", [(1, None, None, None), (2, 700, 3, 1000), (3, 1500, 2, 4000)])
def test_families(spark, monkeypatch, seed, block, rare, batch):
    """Also with tiny blocks, batches and ranges, and saturated frequencies."""
    if block:
        monkeypatch.setattr(ngram_join, "BLOCK_HASHES", block)
        monkeypatch.setattr(ngram_join, "RARE", rare)
        monkeypatch.setattr(ngram_join, "BATCH_HASHES", batch)
        monkeypatch.setattr(ngram_join, "RANGE_HASHES", 2000)
    rows = near_copies(random.Random(seed))
    want, links, sets = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.similar_groups(df).collect())) == sorted(want)
    first = {}
    for (d, _), s in sorted(zip(rows, sets), key=lambda x: x[0][0]):
        first.setdefault(frozenset(s), d)
    classes = [(d, s) for s, d in first.items() if s]
    pairs = {tuple(sorted((a, b))): len(x & y) / len(x | y)
             for (a, x), (b, y) in itertools.combinations(classes, 2) if linked(x, y)}
    got = {(r.id_a, r.id_b): r.jaccard for r in ngram_join.similar_pairs(df).collect()}
    assert got.keys() == pairs.keys() and all(got[k] == pytest.approx(pairs[k]) for k in pairs)


def test_tree_against_all_pairs():
    rng = random.Random(5)
    for _ in range(60):
        sets, sizes = [], []
        for _ in range(40):
            if sets and rng.random() < 0.7:
                s = set(rng.choice(sets)) ^ set(rng.sample(range(60), rng.randrange(0, 4)))
            else:
                s = set(rng.sample(range(60), rng.randrange(1, 50)))
            s = s or {1}
            sets.append(s)
            sizes.append(len(s) + rng.randrange(0, 3))
        want = {(i, j) for j in range(40) for i in range(j)
                if 185 * len(sets[i] & sets[j]) >= 85 * (sizes[i] + sizes[j])}
        for forest in (False, True):
            tree, got = ngram_join.PrefixTree(85, forest), set()
            for i, s in enumerate(sets):
                me = tree.register(sizes[i])
                for j, o in tree.probe(me, sorted(s)):
                    assert o == len(s & sets[j])
                    got.add((j, i))
                tree.insert(me, sorted(s))
            assert got == want if not forest else got <= want
        roots = lambda links: [tuple(sorted(c)) for c in _components(links, 40)]
        assert sorted(roots(got)) == sorted(roots(want))
        assert len(got) <= 39


def _components(links, n):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [x if v == y else v for v in label]
    return [[i for i in range(n) if label[i] == v] for v in set(label)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 50)] + [(7, 7)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(100, 101)] * 3
    got = dict(map(tuple, components(spark.createDataFrame(edges, "x long, y long")).collect()))
    want = {}
    for c in _components([(a, b) for a, b in edges], 400):
        want |= {v: min(c) for v in c if v != min(c)}
    assert got == want
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_edges(spark):
    schema = "doc_id long, text string, cls string, component_id int, n int"
    empty = spark.createDataFrame([], schema)
    assert ngram_join.similar_groups(empty).count() == 0
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(9, long, "", 1, 1), (8, long + " tail", "", 1, 1), (5, None, "", 1, 1), (6, " \t", "", 1, 1),
            (4, "one two", "", 1, 1), (3, "ONE  two", "", 1, 1), (3, "ONE  two", "", 1, 1), (2, "one two x", "", 1, 1),
            (None, "one two", "", 1, 1), (None, "alone", "", 1, 1), (7, "one\x0btwo", "", 1, 1), (1, "É é", "", 1, 1),
            (10, "é é", "", 1, 1)]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in ngram_join.similar_groups(df).collect()]
    want, _, _ = brute([(d, t) for d, t, *_ in rows])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = ngram_join.drop_similar(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(
        [8, 5, 6, 3, 3, 2, None, None, 1, 10], key=repr)
    assert np.array_equal(ngram_join.shingles("", {}), np.zeros(0, np.uint64))
