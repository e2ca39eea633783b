"""Arrow token files: the library's ids, positions, masks and random access."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import token_files
from ledgerlens.llm.common import fresh_dir
from ledgerlens.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def source():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def test_query_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in QUERIES["op10_arrow_token_files"](spark, SF01).collect()}
    docs = sorted(spark.read.parquet(f"{SF01}/documents.parquet").collect(), key=lambda d: d.doc_id)
    assert len(got) == len(docs)
    start = 0
    for d in docs:
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        start += len(ids)


def test_sequences_masks_and_random_access(tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 60_000, n).astype(np.uint16) for n in (1, 7, 8, 9, 100, 31, 16, 3)]
    path = str(tmp_path / "f.arrow")
    with pa.OSFile(path, "wb") as sink:
        w = token_files.SequenceWriter(sink, 8, 2, np.dtype("<u2"))
        for d in docs:
            w.add(d)
        w.close()
    stream = np.concatenate(docs)
    f = token_files.SequenceFile(path)
    n = -(-len(stream) // 8)
    ends = np.cumsum([len(d) for d in docs]) - 1
    for i in [n - 1, 0, *rng.permutation(n)]:
        ids, mask, end = f.sequence(int(i))
        want = stream[8 * i:8 * i + 8]
        assert len(ids) == 8 and mask.sum() == len(want) and (ids[mask] == want).all() and not ids[~mask].any()
        assert (np.flatnonzero(end) + 8 * i).tolist() == [e for e in ends if 8 * i <= e < 8 * i + 8]
    at = 0
    for d in docs:
        assert (f.span(at, len(d)) == d).all()
        at += len(d)
    with pytest.raises((ValueError, EOFError, OSError)):
        f.span(len(stream) - 2, 3)
    # any Arrow reader sees equal-length sequences
    t = pa.ipc.open_stream(pa.memory_map(path)).read_all()
    assert t.num_rows == n and t.schema.field("ids").type == pa.list_(pa.uint16(), 8)
    # a view into the map, not a copy
    base = f.sequence(0)[0]
    assert not base.flags.owndata


def test_edges(spark, source):
    schema = "doc_id long, text string, start int, shard int, _tie int"
    library = Tokenizer.from_file(PATH)
    empty = spark.createDataFrame([], schema)
    assert token_files.write_token_files(empty, fresh_dir(spark, "t"), source, end_id=2).count() == 0
    rows = [(5, "b" * 1000 + " c" * 9000, 1, 1, 1), (None, "x", 1, 1, 1), (3, None, 1, 1, 1), (3, None, 1, 1, 1),
            (4, "a<|endoftext|>b", 1, 1, 1)]
    index = token_files.write_token_files(spark.createDataFrame(rows, schema), fresh_dir(spark, "t"), source,
                                          end_id=2, length=16, batch=2, shards=3)
    got = sorted(token_files.read_token_files(index).collect(), key=lambda r: r.start)
    want = [[2], [2], [*library.encode("a<|endoftext|>b", add_special_tokens=False).ids, 2],
            [*library.encode(rows[0][1], add_special_tokens=False).ids, 2], [*library.encode("x").ids, 2]]
    assert [r.ids for r in got] == want
    assert [r.doc_id for r in got] == [3, 3, 4, 5, None]
    assert [r.start for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()


def test_wide_vocabularies_take_32_bits():
    assert token_files._dtype(1 << 16).itemsize == 2 and token_files._dtype((1 << 16) + 1).itemsize == 4
