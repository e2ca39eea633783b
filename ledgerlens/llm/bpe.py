"""Byte-level BPE encoding and decoding with a minimal acyclic transducer.

The corpus' frequent words are counted by Spark, encoded once, and compiled
into a minimal acyclic automaton: equal suffixes share states, and the numbers
on the arcs of a path add up to the word's place in a table of ids.  Tasks
memory-map the file.  A word outside it is merged exactly.  Ids equal those of
the tokenizers library for the same vocabulary file.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_dir, make_folder, narrow, only_cache, open_fs, short_batches, worker_cache

#: Words of the lexicon at most, and the count from which a word is frequent.
LEXICON_WORDS, MIN_COUNT = 65_536, 3
#: Words that a task remembers or counts before it starts anew.
MEMO_WORDS = 300_000
#: Rows of an output batch.
BATCH_ROWS = 256

# fixed values of the byte-level pre-tokenizer: contractions, letters, numbers,
# other characters, white space
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GENERAL = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
# the same for texts up to U+024F, where letters and numbers are few ranges
_LATIN_L, _LATIN_N, _LATIN_WS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_LATIN = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LATIN_L}]+| ?[{_LATIN_N}]+| ?[^{_LATIN_WS}{_LATIN_L}{_LATIN_N}]+"
    rf"|[{_LATIN_WS}]+(?![^{_LATIN_WS}])|[{_LATIN_WS}]+")
_BEYOND = re.compile("[^\x00-\u024f]")


def split_words(text: str) -> list[str]:
    """The pre-tokenizer's words; joined they are the text."""
    return (_GENERAL if _BEYOND.search(text) else _LATIN).findall(text)


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte: itself for printable Latin-1,
    else the next free code point from 256 on."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[chr(b)] = b
        else:
            out[chr(free)] = b
            free += 1
    return out


# an id takes this many bits
_BITS = 21
_MASK, _NONE = (1 << _BITS) - 1, 1 << 62


class Vocabulary:
    """Ids, merges and special tokens of a tokenizers file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        chars = byte_chars()
        as_bytes = lambda s: bytes(chars[c] for c in s)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for s, i in vocab.items():
            self.token[i] = as_bytes(s)
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        # pair of ids -> rank and merged id in one number, so that the least
        # number among the pairs of a word is its next merge
        self._merge: dict[int, int] = {}
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self._merge[vocab[a] << _BITS | vocab[b]] = rank << _BITS | vocab[a + b]
        self._special_re = re.compile("|".join(
            re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(ordinary text, None) and (special token, its id), in order."""
        at = 0
        if self._special_re is not None:
            for m in self._special_re.finditer(text):
                if m.start() > at:
                    yield text[at:m.start()], None
                yield m[0], self.special[m[0]]
                at = m.end()
        if at < len(text):
            yield (text[at:] if at else text), None

    def merge_word(self, word: bytes) -> list[int]:
        """Exact merges: always the pair of lowest rank, leftmost first."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self._merge.get
        pairs = [get(a << _BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == _NONE:
                break
            i = pairs.index(best)
            ids[i] = new = best & _MASK
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(new << _BITS | ids[i + 1], _NONE)
            if i:
                pairs[i - 1] = get(ids[i - 1] << _BITS | new, _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, for words of any length."""
        n = len(ids)
        after, before, live = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        get = self._merge.get
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (m := get(ids[i] << _BITS | ids[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            best, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], live[j], after[i] = best & _MASK, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := get(ids[a] << _BITS | ids[b], _NONE)) != _NONE:
                    heapq.heappush(heap, (m, a, ids[a], ids[b]))
        return [x for x, alive in zip(ids, live) if alive]


# --- the transducer -------------------------------------------------------

_HEAD = struct.Struct("<8sIIII")
_MAGIC = b"MAT-LEX1"
_ONE = [bytes([b]) for b in range(256)]


def compile_lexicon(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Minimal acyclic transducer over sorted distinct (word, ids).

    States are made minimal as words arrive in order: the part of the last
    word's path that the next word no longer shares is looked up among the
    finished states and replaced by an equal one.  Each arc carries how many
    words sort before those behind it, so a path's sum is the word's rank."""
    register: dict[tuple, int] = {}
    finished: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # open states: [final, arcs]; arc: [label, target]
    last, table, starts = b"", [], [0]

    def close(depth: int) -> None:
        while len(path) > depth:
            final, arcs = path.pop()
            key = (final, tuple(map(tuple, arcs)))
            state = register.get(key)
            if state is None:
                state = register[key] = len(finished)
                finished.append(key)
            if path:
                path[-1][1][-1][1] = state
            else:
                path_root.append(state)

    path_root: list[int] = []
    for word, ids in words:
        if len(starts) > 1 and word <= last:
            raise ValueError("words must be sorted and distinct")
        shared = len(os.path.commonprefix([word, last]))
        close(shared + 1)
        for b in word[shared:]:
            path[-1][1].append([b, -1])
            path.append([False, []])
        path[-1][0] = True
        last = word
        table.extend(ids)
        starts.append(len(table))
    close(0)
    # words behind each state; targets are finished before their sources
    behind = [0] * len(finished)
    for s, (final, arcs) in enumerate(finished):
        behind[s] = final + sum(behind[t] for _, t in arcs)
    first, labels, targets, sums = [0], bytearray(), [], []
    for final, arcs in finished:
        total = int(final)
        for label, t in arcs:
            labels.append(label)
            targets.append(t)
            sums.append(total)
            total += behind[t]
        first.append(len(labels))
    u32 = lambda x: np.asarray(x, "<u4").tobytes()
    finals = bytes(f for f, _ in finished)
    pad = b"\0" * (-(len(labels) + len(finals)) % 4)
    return (_HEAD.pack(_MAGIC, len(finished), len(labels), len(starts) - 1, path_root[0])
            + u32(first) + u32(targets) + u32(sums) + u32(starts) + u32(table)
            + bytes(labels) + finals + pad)


class Lexicon:
    """A compiled lexicon, memory-mapped: nothing is read until it is used."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, states, arcs, self.words, self._root = _HEAD.unpack_from(self._map)
        if magic != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        at, view = _HEAD.size, memoryview(self._map)

        def u32(n):
            nonlocal at
            part = view[at:at + 4 * n].cast("I")
            at += 4 * n
            return part

        self._first, self._target, self._sum = u32(states + 1), u32(arcs), u32(arcs)
        self._start = u32(self.words + 1)
        self._ids = u32(self._start[self.words])
        self._labels, self._finals = at, at + arcs

    def find(self, word: bytes) -> bytes | None:
        """Little-endian 32-bit ids of a word of the lexicon, else None."""
        state, rank, labels, find = self._root, 0, self._labels, self._map.find
        first, target, sums = self._first, self._target, self._sum
        for b in word:
            arc = find(_ONE[b], labels + first[state], labels + first[state + 1]) - labels
            if arc < 0:
                return None
            rank += sums[arc]
            state = target[arc]
        if not self._map[self._finals + state]:
            return None
        return self._ids[self._start[rank]:self._start[rank + 1]].tobytes()


class _Memo(dict):
    """Ids of words that were met; others are looked up or merged."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self._merge, self._find = vocabulary.merge_word, lexicon.find if lexicon is not None else None

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = self._find(raw) if self._find is not None else None
        if ids is None:
            ids = array("I", self._merge(raw)).tobytes()
        self[word] = ids
        return ids


class Encoder:
    """Text to little-endian 32-bit ids: lexicon first, exact merges else."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary = vocabulary
        self._memo = _Memo(vocabulary, lexicon)

    def encode(self, text: str) -> bytes:
        out, memo = [], self._memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for piece, special in self.vocabulary.pieces(text):
            out.append(struct.pack("<I", special) if special is not None
                       else b"".join(map(memo.__getitem__, split_words(piece))))
        return out[0] if len(out) == 1 else b"".join(out)

    def decode(self, ids: bytes) -> str:
        token = self.vocabulary.token
        return b"".join(map(token.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


# --- Spark ----------------------------------------------------------------

_in_worker: dict[str, Encoder] = worker_cache()


def _encoder(key: str, source, lexicon_name: str | None) -> Encoder:
    """The worker's encoder, made once per worker process."""
    only_cache(_in_worker)
    if key not in _in_worker:
        _in_worker.clear()
        lexicon = Lexicon(SparkFiles.get(lexicon_name)) if lexicon_name else None
        _in_worker[key] = Encoder(Vocabulary(source.value), lexicon)
    return _in_worker[key]


def word_counts(docs: DataFrame, text_col: str = "text", special: Iterable[str] = ()) -> DataFrame:
    """(word, n) of all pre-tokenizer words of all whole texts.  Each task
    counts first; special tokens of the vocabulary are no words."""
    cut = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def count(batches):
        only_cache()
        counts: Counter[str] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    for piece in cut.split(text):
                        counts.update(split_words(piece))
                if len(counts) > MEMO_WORDS:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    return (narrow(docs, text=text_col).mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


class Tokenizer:
    """A vocabulary file with the corpus' lexicon, ready for Spark jobs.

    ``fit`` counts words over the whole corpus and compiles the most frequent;
    the choice of words changes speed only, never ids."""

    def __init__(self, spark: SparkSession, path: str):
        short_batches(spark)
        with open(path, encoding="utf-8") as f:
            self._text = f.read()
        self.vocabulary = Vocabulary(self._text)
        self._source = spark.sparkContext.broadcast(self._text)
        self._spark, self._key, self._lexicon = spark, uuid.uuid4().hex, None

    def fit(self, docs: DataFrame, text_col: str = "text", max_words: int = LEXICON_WORDS,
            min_count: int = MIN_COUNT) -> Tokenizer:
        frequent = (word_counts(docs, text_col, self.vocabulary.special).where(F.col("n") >= min_count)
                    .orderBy(F.desc("n"), "word").limit(max_words).select("word"))
        words = sorted(r.word.encode() for r in frequent.toLocalIterator())
        if words:
            merge = self.vocabulary.merge_word
            self.use(compile_lexicon((w, merge(w)) for w in words))
        return self

    def use(self, lexicon: bytes) -> None:
        """Write a compiled lexicon to the shared folder and have every
        executor, also one that joins later, fetch it as a file to map."""
        self._key = uuid.uuid4().hex
        self._lexicon = f"lexicon-{self._key}.bin"
        folder = make_folder(fresh_dir(self._spark, "lexicon"))
        files, path = open_fs(f"{folder}/{self._lexicon}")
        with files.open_output_stream(path) as f:
            f.write(lexicon)
        self._spark.sparkContext.addFile(f"{folder}/{self._lexicon}")

    def encode(self, docs: DataFrame, text_col: str = "text", out_col: str = "ids") -> DataFrame:
        """``docs`` with the ids of each whole text as little-endian unsigned
        32-bit integers in a binary column (in place of a column of that name).
        Null and empty texts have no ids; an empty table gives no rows."""
        key, source, lexicon = self._key, self._source, self._lexicon

        def run(batches):
            encode = _encoder(key, source, lexicon).encode
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(at, BATCH_ROWS)
                    ids = [encode(t) if t else b"" for t in part.column(text_col).to_pylist()]
                    yield _with_column(part, out_col, pa.array(ids, pa.binary()))

        return _map(docs, run, (out_col, "binary"))

    def round_trip(self, docs: DataFrame, text_col: str = "text", ids_col: str = "ids",
                   decoded_col: str = "decoded") -> DataFrame:
        """``encode`` and, from its ids, ``decode`` in one pass, with one
        worker process per task instead of two."""
        key, source, lexicon = self._key, self._source, self._lexicon

        def run(batches):
            encoder = _encoder(key, source, lexicon)
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(at, BATCH_ROWS)
                    ids = [encoder.encode(t) if t else b"" for t in part.column(text_col).to_pylist()]
                    part = _with_column(part, ids_col, pa.array(ids, pa.binary()))
                    yield _with_column(part, decoded_col, pa.array(map(encoder.decode, ids), pa.string()))

        return _map(docs, run, (ids_col, "binary"), (decoded_col, "string"))

    def decode(self, encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
        """``encoded`` with the text of its ids, special tokens included."""
        key, source, lexicon = self._key, self._source, self._lexicon

        def run(batches):
            decode = _encoder(key, source, lexicon).decode
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(at, BATCH_ROWS)
                    texts = [decode(i or b"") for i in part.column(ids_col).to_pylist()]
                    yield _with_column(part, out_col, pa.array(texts, pa.string()))

        return _map(encoded, run, (out_col, "string"))


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), column], [*keep, name])


def _map(df: DataFrame, run, *columns: tuple[str, str]) -> DataFrame:
    """``df.mapInArrow(run)``, whose columns of these names and types come last."""
    names = [name for name, _ in columns]
    kinds = {"binary": T.BinaryType(), "string": T.StringType()}
    return df.mapInArrow(run, T.StructType([f for f in df.schema.fields if f.name not in names]
                                           + [T.StructField(name, kinds[kind]) for name, kind in columns]))


def digests(tokenizer: Tokenizer, docs: DataFrame, *, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    return tokenizer.round_trip(rows).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
