"""Transducer BPE against the tokenizers library; the lexicon's minimality."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import bpe
from ledgerlens.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_query_equals_the_library(spark, library):
    got = {r.doc_id: r for r in QUERIES["op5_transducer_bpe"](spark, SF01).collect()}
    docs = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_random_texts(vocabulary, library):
    encoder, rng = bpe.Encoder(vocabulary, None), random.Random(3)
    letters = "ab 's't're'll 12.,  \n\t\r\x1c\x85\xa0é²½ªñ中𝟘\U0001F600<|"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["x" * 5000, "ab" * 3000, " " * 900 + "a", "", "a<|endoftext|> b<|endoftext|><|endoftext|>"]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == ids
        assert encoder.decode(encoder.encode(t)) == library.decode(ids, skip_special_tokens=False)


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = sorted({p + s for p in (b"st", b"t", b"m", b"pr") for s in (b"op", b"ops", b"opped", b"opping")})
    lexicon = bpe.compile_lexicon((w, [i, i + 1, i + 2][: i % 4]) for i, w in enumerate(words))
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon)
    found = bpe.Lexicon(str(path))
    for i, w in enumerate(words):
        assert np.frombuffer(found.find(w), "<u4").tolist() == [i, i + 1, i + 2][: i % 4]
    for w in (b"", b"s", b"sto", b"stopp", b"stopsx", b"x"):
        assert found.find(w) is None
    # right languages, the states of a minimal automaton: one per distinct set of continuations
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    states = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes}
    assert bpe._HEAD.unpack_from(lexicon)[1] == len(states)
    with pytest.raises(ValueError):
        bpe.compile_lexicon([(b"b", []), (b"a", [])])


def test_lexicon_changes_nothing(spark, vocabulary):
    docs = spark.createDataFrame([(1, "the cat the cat sat"), (2, "thethe cats")], "doc_id long, text string")
    plain = bpe.Tokenizer(spark, PATH)
    fitted = bpe.Tokenizer(spark, PATH).fit(docs, min_count=2)
    assert plain._lexicon is None and fitted._lexicon
    assert sorted(plain.encode(docs).collect()) == sorted(fitted.encode(docs).collect())


def test_counts_are_whole(spark):
    docs = spark.createDataFrame([("a b a",), (None,), ("",), ("a<|endoftext|>a",)], "text string")
    counts = {r.word: r.n for r in bpe.word_counts(docs, special=["<|endoftext|>"]).collect()}
    assert counts == {"a": 3, " b": 1, " a": 1}


def test_edges(spark):
    schema = "doc_id long, text string, ids int, decoded int, n_tokens int"
    tok = bpe.Tokenizer(spark, PATH)
    empty = spark.createDataFrame([], schema)
    assert bpe.digests(tok.fit(empty), empty).count() == 0
    df = spark.createDataFrame([(None, None, 1, 1, 1), (2, "", 1, 1, 1), (2, "", 1, 1, 1), (3, "y " * 200_000, 1, 1, 1)], schema)
    rows = bpe.digests(tok, df).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id != 3] == [(0, none, none)] * 3
    assert [r.decoded_sha256 for r in rows if r.doc_id == 3] == [hashlib.sha256(b"y " * 200_000).hexdigest()]
    assert set(tok.encode(df).columns) == set(df.columns)
    twice = tok.decode(tok.encode(df)).select("doc_id", "ids", "decoded").collect()
    once = tok.round_trip(df)
    assert set(once.columns) == set(df.columns)
    assert sorted(once.select("doc_id", "ids", "decoded").collect(), key=repr) == sorted(twice, key=repr)
