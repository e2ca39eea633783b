"""Token-id output: Arrow stream files of fixed-size-list batches.

Documents in ascending id order are one stream of ids, cut into sequences of
equal length.  Each shard (a range of ids) is one Arrow IPC stream written to
a file; all its batches but the last have the same number of rows, and all
columns have fixed width, so batch ``i`` begins at ``first + i * stride`` and
a sequence is read from a memory map without copying.  Columns::

    ids   fixed_size_list<uint16 | uint32>[L]
    mask  fixed_size_list<bool>[L]   true where a position holds an id
    ends  fixed_size_list<bool>[L]   true at the last id of a document

A table ``index`` beside the files maps doc_id to shard, start and length.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_chars, split_words
from .common import (commit_file, make_folder, materialise, narrow, only_cache, open_fs, short_batches,
                     shuffle_partitions, worker_cache)

#: Ids of a sequence, and sequences of a batch.
SEQUENCE, BATCH_SEQUENCES = 2048, 64
INDEX_ROWS = 2048
#: Words that a worker remembers before it starts anew (about 150 MB).
MEMO_WORDS = 600_000


def _dtype(vocabulary_size: int):
    return np.dtype("<u2") if vocabulary_size <= 1 << 16 else np.dtype("<u4")


def schema(length: int, dtype: np.dtype) -> pa.Schema:
    kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)),
                      ("ends", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Packs documents' ids into sequences and writes equal batches."""

    def __init__(self, sink, length: int, batch: int, dtype: np.dtype):
        self._schema, self._length, self._dtype = schema(length, dtype), length, dtype
        self._room = length * batch
        self._out = pa.ipc.new_stream(sink, self._schema)
        self._ids, self._ends = np.zeros(self._room, dtype), np.zeros(self._room, bool)
        self._used = 0
        self.written = 0

    def add(self, ids: np.ndarray) -> None:
        """One document; its last id is marked as its end."""
        at = 0
        while at < len(ids):
            n = min(self._room - self._used, len(ids) - at)
            self._ids[self._used:self._used + n] = ids[at:at + n]
            self._used += n
            at += n
            if at == len(ids):
                self._ends[self._used - 1] = True
            if self._used == self._room:
                self._flush()
        self.written += len(ids)

    def _flush(self) -> None:
        rows = -(-self._used // self._length)
        n = rows * self._length
        mask = np.arange(n) < self._used
        lists = [pa.FixedSizeListArray.from_arrays(values, self._length) for values in (
            pa.array(self._ids[:n]), pa.array(mask), pa.array(self._ends[:n]))]
        self._out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self._schema))
        self._ids[:] = 0
        self._ends[:] = False
        self._used = 0

    def close(self) -> None:
        if self._used:
            self._flush()
        self._out.close()


class SequenceFile:
    """Random access to the sequences of a file; a local file is mapped."""

    def __init__(self, uri: str):
        files, path = open_fs(uri)
        if files.type_name == "local":
            self._file = pa.memory_map(path)
        else:
            self._file = files.open_input_file(path)
        size = self._file.size()
        reader = pa.ipc.open_stream(self._file)
        self.schema = reader.schema
        self._first = self._file.tell()
        self.length = self.schema.field("ids").type.list_size
        batch = next(iter(reader), None)
        self._stride = self._file.tell() - self._first
        self.rows = batch.num_rows if batch is not None else 0
        self._size, self._last = size, (-1, None)

    def batch(self, i: int) -> pa.RecordBatch:
        """Batch ``i``, found by its computed offset, not by reading others."""
        if self._last[0] != i:
            self._file.seek(self._first + i * self._stride)
            self._last = (i, pa.ipc.read_record_batch(pa.ipc.read_message(self._file), self.schema))
        return self._last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, mask, ends) of sequence ``i``; the ids are a view."""
        b, row = self.batch(i // self.rows), i % self.rows
        part = slice(row * self.length, (row + 1) * self.length)
        ids = b.column("ids").values.to_numpy(zero_copy_only=True)[part]
        bits = [b.column(c).values.slice(part.start, self.length).to_numpy(zero_copy_only=False)
                for c in ("mask", "ends")]
        return ids, *bits

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` of the shard's stream, checked
        against mask and end marks."""
        room = self.rows * self.length
        parts, at, left = [], start, n
        while left:
            b, o = self.batch(at // room), at % room
            k = min(left, len(b) * self.length - o)
            if k <= 0:
                raise EOFError(f"position {at} is beyond the file")
            parts.append(b.column("ids").values.to_numpy(zero_copy_only=True)[o:o + k])
            if not b.column("mask").values[o + k - 1].as_py():
                raise ValueError(f"position {at + k - 1} is padding")
            at, left = at + k, left - k
        if n and not b.column("ends").values[o + k - 1].as_py():
            raise ValueError(f"no document ends at {start + n - 1}")
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint16)])


class _Words(dict):
    """Ids of the pre-tokenizer's words, asked of the library's model once.

    Byte-level BPE never merges across words, so a text's ids are those of
    its words in order."""

    def __init__(self, tok: Tokenizer, kind: str):
        self._model, self._kind = tok.model, kind  # the model must be kept with its tokenizer
        self._tok = tok
        self._printable = {b: c for c, b in byte_chars().items()}

    def __missing__(self, word: str) -> bytes:
        raw = word.encode().decode("latin-1").translate(self._printable)
        ids = self[word] = array(self._kind, [t.id for t in self._model.tokenize(raw)]).tobytes()
        return ids


_in_worker: dict[str, _Words] = worker_cache()


def _words(key: str, source, dtype: np.dtype) -> _Words:
    """The worker's words, made once per worker process."""
    only_cache(_in_worker)
    if key not in _in_worker:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _in_worker.clear()
        _in_worker[key] = _Words(Tokenizer.from_str(source.value), "H" if dtype.itemsize == 2 else "I")
    return _in_worker[key]


def _word_wise(tokenizer_json: str) -> bool:
    """Whether a tokenizers file is plain byte-level BPE."""
    spec = json.loads(tokenizer_json)
    split = spec.get("pre_tokenizer") or {}
    return (spec["model"]["type"] == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space") and split.get("use_regex", True))


def _encode(words: _Words, text: str, dtype: np.dtype, special: list[str] | None) -> bytes:
    """Ids of a whole text.  One with a special token, and all where
    ``special`` is None, go to the library whole."""
    if special is None or any(s in text for s in special):
        return np.asarray(words._tok.encode(text, add_special_tokens=False).ids, dtype).tobytes()
    if len(words) > MEMO_WORDS:
        words.clear()
    return b"".join(map(words.__getitem__, split_words(text)))


def write_token_files(docs: DataFrame, folder: str, tokenizer_json: str, *, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE,
                      batch: int = BATCH_SEQUENCES, shards: int | None = None) -> DataFrame:
    """Encode, append ``end_id``, write shards into ``folder``; returns the
    index: doc_id, shard, start_in_shard, start, n_tokens, path.

    * null text: only the end id; null doc_id sorts last; equal ids in text
      hash order; repeated rows stay
    * empty table: no files, no rows; further columns are not carried
    """
    spark = docs.sparkSession
    tok = Tokenizer.from_str(tokenizer_json)
    dtype = _dtype(max(tok.get_vocab_size(with_added_tokens=True), end_id + 1))
    special = [t.content for t in tok.get_added_tokens_decoder().values()] if _word_wise(tokenizer_json) else None
    key, source = uuid.uuid4().hex, spark.sparkContext.broadcast(tokenizer_json)
    make_folder(folder)
    short_batches(spark)
    order = [F.asc_nulls_last("doc_id"), F.asc("_tie")]
    rows = (narrow(docs, doc_id=id_col, text=text_col)
            .withColumn("_tie", F.xxhash64("text"))
            .repartitionByRange(shards or shuffle_partitions(spark), *order)
            .sortWithinPartitions(*order).select("doc_id", "text"))

    def write(batches):
        task = TaskContext.get()
        shard = task.partitionId()
        files, root = open_fs(folder)
        name = f"tokens-{shard:06d}.arrow"
        tmp = f"{root}/_tmp-{name}-{task.taskAttemptId()}"
        words = _words(key, source, dtype)
        sink = writer = None
        index: list[tuple] = []

        def rows():
            ids, starts, counts = zip(*index)
            out = pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([shard] * len(ids), pa.int32()),
                pa.array(starts, pa.int64()), pa.array(counts, pa.int64()),
                pa.array([f"{folder}/{name}"] * len(ids), pa.string())],
                ["doc_id", "shard", "start_in_shard", "n_tokens", "path"])
            index.clear()
            return out

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                if writer is None:
                    sink = files.open_output_stream(tmp)
                    writer = SequenceWriter(sink, length, batch, dtype)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                    ids = _encode(words, text, dtype, special)
                    ids = np.append(np.frombuffer(ids, dtype), dtype.type(end_id))
                    index.append((doc_id, writer.written, len(ids)))
                    writer.add(ids)
                if len(index) >= INDEX_ROWS:
                    yield rows()
        if writer is not None:
            writer.close()
            sink.close()
            commit_file(files, tmp, f"{root}/{name}")
        if index:
            yield rows()

    index = materialise(rows.mapInArrow(
        write, "doc_id long, shard int, start_in_shard long, n_tokens long, path string"), "token-index")
    # one row per shard meets in one task
    w = Window.orderBy("shard")
    before = (index.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
              .select("shard", (F.sum("_n").over(w) - F.col("_n")).alias("_before")))
    return index.join(F.broadcast(before), "shard").select(
        "doc_id", "shard", "start_in_shard", (F.col("_before") + F.col("start_in_shard")).alias("start"),
        "n_tokens", "path")


def read_token_files(index: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """Per indexed document: doc_id, start, n_tokens, ids_crc32 and (with
    ``with_ids``) ids, taken from the files.  Rows of a shard are read in
    order, so each batch of a file is mapped once."""
    spark = index.sparkSession
    rows = (index.select("doc_id", "start", "n_tokens", "path", "start_in_shard", "shard")
            .repartition(shuffle_partitions(spark), "shard")
            .sortWithinPartitions("shard", "start_in_shard"))

    def read(batches):
        path = opened = None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                crcs, counts, lists = [], [], []
                for p, s, n in zip(*(part.column(c).to_pylist() for c in ("path", "start_in_shard", "n_tokens"))):
                    if p != path:
                        path, opened = p, SequenceFile(p)
                    ids = opened.span(s, n).astype("<u4")
                    counts.append(len(ids))
                    crcs.append(zlib.crc32(ids.tobytes()))
                    if with_ids:
                        lists.append(ids)
                columns = [part.column("doc_id"), part.column("start"), pa.array(counts, pa.int64()),
                           pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype("i8") for x in lists], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"
                           + (", ids array<long>" if with_ids else ""))
