"""Byte GRU: exact gradients, masking, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from ledgerlens.llm import langid
from ledgerlens.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def test_gradients_match_finite_differences():
    model = langid.Model(["a", "b", "c"], hidden=3, window=7, seed=1)
    for p in model.params():
        p += np.random.default_rng(2).normal(size=p.shape).astype(np.float32) * 0.1
    x, mask = langid.pack([b"abcdefg", b"xyz", b"aaaaa", b"q"], 7)
    y = np.array([0, 1, 2, 1])
    _, grads = model.loss(x, mask, y)
    rng = np.random.default_rng(0)
    for p, g in zip(model.params(), grads):
        flat, used = p.reshape(-1), np.flatnonzero(np.abs(g.reshape(-1)) > 1e-3)
        for i in rng.choice(used, min(6, len(used)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-2
            up, _ = model.loss(x, mask, y)
            flat[i] = old - 1e-2
            down, _ = model.loss(x, mask, y)
            flat[i] = old
            assert (up - down) / 2e-2 == pytest.approx(g.reshape(-1)[i], rel=0.05, abs=2e-4)


def test_fast_run_equals_training_forward():
    d = langid.Direction(np.random.default_rng(5), 4)
    d.b += 0.3
    x, mask = langid.pack([b"hello wo", b"abc", b"zz"], 8)
    m = mask.astype(np.float32)[:, None, :]
    states, _ = d.forward(x, m)
    assert np.allclose(d.run(x, m, mask.all(1)), states, atol=1e-5)


def test_pooling_covers_whole_texts():
    model = langid.Model(["a", "b"], hidden=4, window=8, seed=3)
    texts = [b"x" * 8, b"hello world, this is longer", b"", b"ab", bytes(range(256)) * 3]
    got = model.texts(texts)
    for t, row in zip(texts, got):
        parts = [t[i:i + 8] for i in range(0, len(t), 8)]
        want = np.zeros(2)
        for w in parts:
            x, mask = langid.pack([w], 8)
            want += model.positions(x, mask)[:len(w), :, 0].sum(0)
        assert np.allclose(row, want / max(1, len(t)), atol=1e-4)


def test_held_out_accuracy(spark):
    rows = QUERIES["op7_gru_language"](spark, SF01).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    labels = {d.lang for d in docs.values() if d.lang}
    assert {r.lang_pred for r in rows} <= labels | {"und"} and all(0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in test]) > 0.97


def test_training_ignores_held_out_rows(spark):
    rows = [(i, "abc abc", "x") for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows += [(i, "zzz", "secret") for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows += [(None, "ß", None), (1000, None, "x"), (1001, "123", "digits only")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), epochs=1)
    assert model.labels == ["x"]


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string, _k int, w int"
    empty = spark.createDataFrame([], schema)
    model = langid.train(empty)
    assert model.labels == [] and langid.detect(empty, model).count() == 0
    trained = langid.Model(["de", "en"])
    df = spark.createDataFrame([(1, None, "en", "s", 1, 1), (2, " 12 ½ _", "en", "s", 1, 1), (3, "", "de", "s", 1, 1),
                                (4, "word " * 60_000, "en", "s", 1, 1), (4, "é", "en", "s", 1, 1)], schema)
    assert {r.lang_pred for r in langid.detect(df, model).collect()} == {"und"}
    rows = langid.detect(df, trained).collect()
    assert [r.lang_pred for r in rows if r.doc_id < 4] == ["und"] * 3 and [r.score for r in rows if r.doc_id < 4] == [0.0] * 3
    assert all(r.lang_pred in ("de", "en") and 0 < r.score <= 1 for r in rows if r.doc_id == 4)
    runs = langid.label_runs(trained, "héllo wörld" * 30)
    assert runs[0][0] == 0 and runs[-1][1] == len(("héllo wörld" * 30).encode())
    assert all(a[1] == b[0] for a, b in zip(runs, runs[1:]))


def test_rows_without_or_with_repeated_ids_train(spark):
    """Null ids and one id for all rows; rows that repeat serve once."""
    texts = {"aa": "ab ba abab baba " * 12, "zz": "xy yx xyxy yxyx " * 12}
    rows = [(i, t + str(k), lang) for lang, t in texts.items() for k in range(20) for i in (None, 7)]
    rows += [rows[0]] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, docs_per_label=16, epochs=6)
    assert model.labels == ["aa", "zz"]
    got = {r.lang: r.lang_pred for r in langid.detect(docs, model).collect()}
    assert got == {"aa": "aa", "zz": "zz"}
