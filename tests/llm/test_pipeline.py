"""The pipeline, stage by stage, against brute force on the whole table."""

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlens.llm import decontaminate
from ledgerlens.llm.common import fresh_dir
from test_ngram_join import grams

SF01 = "/root/testdata/sf0.01"


def components(rows):
    """Smallest id reachable over links of 5-gram Jaccard of 0.8 or more."""
    sets, index, parent = [grams(t, 5) for _, t in rows], {}, list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in index.get(g, ())}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for g in s:
            index.setdefault(g, []).append(i)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[find(i)] = min(d, smallest.get(find(i), d))
    return {d: smallest[find(i)] for i, (d, _) in enumerate(rows)}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_dir(spark, f"test-{name}")
        stage(spark, docs, SF01).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
    # language: only documents without a letter go
    want = {d: t for d, t in kept.items() if any(map(str.isalpha, t or ""))}
    assert {r.doc_id: r.text for r in out["language_id"]} == want
    # exact: the smallest id of each normalised text
    first = {}
    for d, t in sorted(want.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
    want = {d: want[d] for d in first.values()}
    assert {r.doc_id: r.text for r in out["exact_dedup"]} == want
    # near: the smallest id of each component
    named = components(sorted(want.items()))
    want = {d: t for d, t in want.items() if named[d] == d}
    assert {r.doc_id: r.text for r in out["ngram_jaccard_join"]} == want
    # benchmark: every document with a whole item goes, hardly any other
    items = [" ".join(decontaminate.words(r.text)) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    held = {d for d, t in want.items() if any(f" {i} " in f" {' '.join(decontaminate.words(t))} " for i in items)}
    left = {r.doc_id for r in out["benchmark_decontamination"]}
    assert held and left.isdisjoint(held) and len(want) - len(held) - len(left) <= 0.01 * len(want)
    # bpe: the library's ids, and the text again
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id for r in out["bpe"]} == left
    for r in out["bpe"]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert bytes(r.ids) == np.asarray(ids, "<u4").tobytes() and r.n_tokens == len(ids) and r.round_trip


def test_run_is_the_chain(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and set(got.columns) >= {"doc_id", "text", "lang", "source", "n_chars", "ids"}


def test_stages_take_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, _maybe int"
    for rows in ([], [(1, None, None, None, None, None, None), (2, "", "en", "s", 0, "", 1),
                      (3, "a word", "en", "s", 6, "", 1), (3, "a word", "en", "s", 6, "", 1), (None, "b", None, None, 1, "", 1)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            path = fresh_dir(spark, f"test-{name}")
            stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path) if name != "bpe" else spark.read.parquet(path)
        assert sorted((r.doc_id or 0) for r in docs.collect()) == ([0, 3] if rows else [])


def test_lettered_documents_stay_without_a_label_to_train_on(spark):
    schema = "doc_id long, text string, lang string, _lang_pred int"
    rows = [(1, "a word", None, 1), (2, "é", None, 2), (3, "12 ?!", None, 3), (4, None, None, 4), (5, "", None, 5),
            (6, "a word", None, 6)]
    odd = [(1, "a word", None, 1), (2, "12", "en", 2), (3, "", "de", 3)]  # the labelled rows have no letter
    for table, kept in ((rows, [1, 2, 6]), (odd, [1])):
        docs = spark.createDataFrame(table, schema)
        got = corpus_pipeline.language_stage(spark, docs, "/root/testdata/sf0.001")
        assert got.schema == docs.schema
        assert sorted(got.collect()) == [tuple(r) for r in table if r[0] in kept]
