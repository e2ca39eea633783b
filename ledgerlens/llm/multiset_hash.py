"""Order-independent document fingerprints: a homomorphic multiset hash.

A text is the multiset of its paragraphs (the strings between line feeds).
Every paragraph is hashed into one wide vector, and a fingerprint is the sum of
its paragraphs' vectors, lane by lane modulo a power of two:

* ``WIDE`` lanes modulo 2**64 from a cryptographic hash of the whole
  paragraph.  They decide equality: texts have equal fingerprints if their
  paragraphs are the same in any order (others collide by chance only).
* ``NEAR`` lanes modulo 2**16, to which every pair of neighbouring words of
  the paragraph adds 1 or -1 in a lane of its own.  The scalar product of two
  texts' lanes estimates that of their pair counts (standard error about
  ``1 / sqrt(NEAR)`` of the norms), whence the likeness.

A sum can be changed in place: inserting a paragraph adds its vector, deleting
one subtracts it (``update``), and the fingerprint of several texts together is
the sum of theirs.  Nothing else of the text is read for that.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, only_cache, short_batches, shuffle_partitions

WIDE, NEAR = 8, 256
_WIDE_BYTES = 8 * WIDE
#: Text bytes of a range of ids; the ranges of ``edited_fingerprints``.
RANGE_BYTES = 128 << 20
MEMO_WORDS = 400_000

#: Words; longer ones are cut, so that text without blanks has pairs, too.
_WORD = re.compile(r"\S{1,12}")
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Fingerprint:
    """A sum of paragraph vectors; ``+`` and ``-`` work lane by lane."""

    __slots__ = ("wide", "near")

    def __init__(self, wide: np.ndarray | None = None, near: np.ndarray | None = None):
        self.wide = np.zeros(WIDE, np.uint64) if wide is None else wide
        self.near = np.zeros(NEAR, np.int16) if near is None else near

    @classmethod
    def of(cls, paragraphs: Iterable[str], memo: dict | None = None) -> Fingerprint:
        """The sum of the vectors of the paragraphs."""
        memo = _WordHashes() if memo is None else memo
        digests, hashes = [], []
        for p in paragraphs:
            digests.append(hashlib.blake2b(p.encode(), digest_size=_WIDE_BYTES).digest())
            words = _WORD.findall(p)
            if words:
                hashes.append(0)  # the beginning of a paragraph is the first word's neighbour
                hashes.extend(map(memo.__getitem__, words))
        wide = np.frombuffer(b"".join(digests), "<u8").reshape(-1, WIDE).sum(0, dtype=np.uint64)
        h = np.array(hashes, np.uint64)
        a, b = h[:-1], h[1:]
        pairs = ((a * _MIX1) ^ (a >> np.uint64(32))) + b
        pairs = pairs[b != 0] * _MIX2
        pairs ^= pairs >> np.uint64(29)
        pairs *= _MIX1
        lane = (pairs >> np.uint64(40)).astype(np.int64) % NEAR
        sign = np.where(pairs >> np.uint64(63), 1.0, -1.0)
        near = np.bincount(lane, sign, NEAR).astype(np.int64).astype(np.int16)
        return cls(wide, near)

    @classmethod
    def decode(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw[:_WIDE_BYTES], "<u8"), np.frombuffer(raw[_WIDE_BYTES:], "<i2"))

    def encode(self) -> str:
        return base64.b64encode(self.wide.astype("<u8").tobytes() + self.near.astype("<i2").tobytes()).decode()

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide + other.wide, self.near + other.near)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide - other.wide, self.near - other.near)

    def __eq__(self, other) -> bool:
        return np.array_equal(self.wide, other.wide) and np.array_equal(self.near, other.near)

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, else the estimate of 2 x·y / (x·x + y·y)
        over the counts of word pairs, within 0 and 1 (0 without any word)."""
        if self == other:
            return 1.0
        x, y = self.near.astype(np.int64), other.near.astype(np.int64)
        both = int(x @ x + y @ y)
        return min(1.0, max(0.0, 2 * int(x @ y) / both)) if both else 0.0


def paragraphs(text: str | None) -> list[str]:
    return (text or "").split("\n")


def edited(text: str, following: str) -> tuple[str, int]:
    """The text whose last quarter of code points is replaced by as many (or
    all) of the first of ``following``, and where that begins."""
    cut = len(text) - len(text) // 4
    return text[:cut] + following[:len(text) - cut], cut


def edited_fingerprint(whole: Fingerprint, text: str, new: str, cut: int, memo: dict) -> Fingerprint:
    """The fingerprint of ``new``, which agrees with ``text`` up to ``cut``,
    from that of ``text``: only the paragraphs behind the last line feed
    before the cut are deleted and inserted."""
    at = text.rfind("\n", 0, cut) + 1
    return whole - Fingerprint.of(paragraphs(text[at:]), memo) + Fingerprint.of(paragraphs(new[at:]), memo)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 out_col: str = "fingerprint") -> DataFrame:
    """doc_id and the fingerprint (base64) of every row; no shuffle.

    * null text equals empty: one empty paragraph; empty table: no rows
    * repeated rows each have their row; further columns are not carried
    """
    def run(batches):
        only_cache()
        memo = _WordHashes()
        for batch in batches:
            out = [Fingerprint.of(paragraphs(t.as_py()), memo).encode() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", out_col])

    short_batches(docs.sparkSession)
    rows = narrow(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {_kind(rows)}, {out_col} string")


def _kind(rows: DataFrame, col: str = "doc_id") -> str:
    return rows.schema[col].dataType.simpleString()


def update(prints: DataFrame, edits: DataFrame, *, id_col: str = "doc_id", print_col: str = "fingerprint",
           paragraph_col: str = "paragraph", count_col: str = "count") -> DataFrame:
    """Fingerprints after inserting (``count`` > 0) and deleting (< 0) so many
    copies of paragraphs: doc_id, fingerprint.  The texts are not read.

    Tasks first add up their own edits per document, so a document with a
    third of all edits sends one row per batch; those are added up in a
    stream, never held together.

    * an id that only the edits have starts from the empty sum; a null id is
      an id like any other; rows of ``prints`` under one id are added up
    * null paragraph equals empty; null count: 0
    """
    def changes(batches):
        only_cache()
        memo = _WordHashes()
        for batch in batches:
            sums: dict = {}
            for i, p, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "paragraph", "count"))):
                one = Fingerprint.of([p or ""], memo)
                n = n or 0
                times = Fingerprint(one.wide * np.uint64(n % (1 << 64)),
                                    (one.near.astype(np.int64) * (n % (1 << 16))).astype(np.int16))
                sums[i] = sums[i] + times if i in sums else times
            yield _rows(sums.keys(), sums.values(), batch.schema.field("doc_id").type)

    def total(batches):
        only_cache()
        at, held, started = None, None, False
        for batch in batches:
            ids, found = [], []
            for i, p in zip(batch.column("doc_id").to_pylist(), batch.column("fingerprint").to_pylist()):
                new = Fingerprint.decode(p) if p else Fingerprint()
                if started and i == at:
                    held = held + new
                    continue
                if started:
                    ids.append(at)
                    found.append(held)
                at, held, started = i, new, True
            kind = batch.schema.field("doc_id").type
            yield _rows(ids, found, kind)
        if started:
            yield _rows([at], [held], kind)

    short_batches(prints.sparkSession)
    base = narrow(prints, doc_id=id_col, fingerprint=print_col)
    schema = f"doc_id {_kind(base)}, fingerprint string"
    delta = narrow(edits, doc_id=id_col, paragraph=paragraph_col, count=count_col).mapInArrow(changes, schema)
    return (base.unionByName(delta).repartition("doc_id").sortWithinPartitions("doc_id")
            .mapInArrow(total, schema))


def _rows(ids, found, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(ids), kind), pa.array([f.encode() for f in found], pa.string())],
                                      ["doc_id", "fingerprint"])


def _ranges(rows: DataFrame) -> list[tuple]:
    """The first key (id is null, id, hash of the text) of every range of ids,
    ascending.  One narrow pass over keys; a row per range comes back."""
    keys = rows.select(*_key(), F.octet_length("text").alias("bytes"))
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    parts = max(shuffle_partitions(rows.sparkSession), -(-total // RANGE_BYTES))
    first = (keys.repartitionByRange(parts, "none", "doc_id", "h").groupBy(F.spark_partition_id().alias("p"))
             .agg(F.min(F.struct("none", "doc_id", "h")).alias("k")).select("k.*"))
    return sorted((tuple(r) for r in first.collect()), key=_order)


def _key() -> list:
    return [F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64("text").alias("h")]


def _order(key: tuple) -> tuple:
    none, i, h = key
    return (none, h) if none else (none, i, h)


_OUT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, that of its edited text, and two likenesses:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has the first code points of the next text (ascending
    doc_id, after the last the first) in place of its last quarter.  Texts are
    shuffled once, to ranges of ids; the first row of a range is also sent to
    the end of the range before it, so neighbours meet in a stream that holds
    two texts.

    * null text equals empty; null ids come last; rows of one id follow each
      other by a hash of the text, equal rows (id and text) in any order
    * one row is its own next; empty table: no rows; further columns are not
      carried
    """
    short_batches(docs.sparkSession)
    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = _kind(rows)
    schema = f"doc_id {kind}, {_OUT}"
    firsts = _ranges(rows)
    if not firsts:
        return docs.sparkSession.createDataFrame([], schema)
    order, n = [_order(k) for k in firsts], len(firsts)

    @F.pandas_udf("array<int>")
    def dealt(none: pd.Series, i: pd.Series, h: pd.Series) -> pd.Series:
        """The row's range, and for the first of a range the one before."""
        out = []
        for key in zip(none.tolist(), i.tolist(), h.tolist()):
            key = _order(key)
            at = max(0, bisect_right(order, key) - 1)
            out.append([at, (at - 1) % n] if key == order[at] else [at])
        return pd.Series(out)

    spread = (rows.select(*_key(), "text").withColumn("to", dealt("none", F.coalesce("doc_id", _any(kind)), "h"))
              .select("none", "doc_id", "h", "text", F.posexplode("to").alias("copy", "at")))
    return (spread.repartitionById(n, "at").sortWithinPartitions("at", "copy", "none", "doc_id", "h")
            .select("doc_id", "text", "copy", "at").mapInArrow(_neighbours, schema))


def _any(kind: str):
    """Some value in place of a null id, which the order does not look at."""
    return F.lit("0").cast(kind)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only_cache()
    memo = _WordHashes()
    before = None  # (range, id, text, fingerprint) of the row whose next comes
    for batch in batches:
        out = []
        for i, text, copy, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copy", "at"))):
            if copy and before is None:
                continue
            whole = Fingerprint.of(paragraphs(text), memo)
            if before is not None:
                out.append(_compared(*before, text, whole, memo))
            before = None if copy else (i, text, whole)
        columns = list(zip(*out)) or [()] * 7
        kinds = [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _compared(i, text: str, whole: Fingerprint, following: str, after: Fingerprint, memo: dict) -> tuple:
    new, cut = edited(text, following)
    changed = edited_fingerprint(whole, text, new, cut, memo) if new != text else whole
    return (i, len(text), hashlib.sha256(new.encode()).hexdigest(), whole.encode(), changed.encode(),
            whole.likeness(changed), whole.likeness(after))
