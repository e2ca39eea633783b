"""Exact deduplication with a two-pass Bloom filter.

Pass one hashes every whole text once into a narrow table and marks the filter
positions that two or more rows hit; tasks build it from their own rows.  Pass two tests every row against the
marked positions: a row whose positions are not all marked is certainly
unique and passes straight through; only the others shuffle, and they shuffle
their hashes, not their texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, narrow, only_cache, shuffle_partitions

#: Filter positions tested per row.
PROBES = 2
#: Bits of the filter: 16 per row, a power of two, within these bounds.  The
#: upper one bounds the broadcast (256 MB); with more rows than fit, more rows
#: take the exact way over the shuffle and the result is the same.
MIN_BITS, MAX_BITS = 1 << 20, 1 << 31
#: Rows whose positions a task packs at once, and rows per range of the filter.
HELD_ROWS, RANGE_ROWS = 1 << 20, 1 << 20


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def filter_bits(n_rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (16 * max(1, n_rows) - 1).bit_length()))


def _positions(digest: Column, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(bits)) for i in range(PROBES)])


def repeated_positions(hashed: DataFrame, digest_col: str, bits: int, n_rows: int) -> np.ndarray:
    """First pass: the bitmap of positions hit by at least two rows.

    The filter is built in the tasks: each keeps, of its own rows, the sorted
    positions that were hit and whether they were hit twice (a row's own equal
    positions count once), and sends them packed by range of the filter.  What
    is hit in two tasks is hit twice.  A text with any number of copies sends
    two positions per task, no row is shuffled, and the collected bitmap is
    ``bits / 8`` bytes at most."""
    ranges = max(shuffle_partitions(hashed.sparkSession), -(-n_rows // RANGE_ROWS))
    size = -(-bits // ranges // 8) * 8 + 8  # whole bytes

    def run(batches):
        only_cache()
        held, rows = [], 0

        def out():
            positions, hits = np.unique(np.concatenate(held), return_counts=True)
            edges = np.searchsorted(positions, np.arange(0, bits + size, size))
            used = np.flatnonzero(np.diff(edges))
            parts = [slice(edges[g], edges[g + 1]) for g in used]
            return pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int64()), pa.array([(positions[p] % size).astype(np.uint32).tobytes() for p in parts], pa.binary()),
                 pa.array([np.packbits(hits[p] > 1).tobytes() for p in parts], pa.binary())], ["g", "at", "twice"])

        for batch in batches:
            first, second = (batch.column(c).to_numpy() for c in ("p0", "p1"))
            held += [first, second[second != first]]
            rows += len(first)
            if rows >= HELD_ROWS:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [np.frombuffer(a, np.uint32) for a in pdf["at"]]
        hits = [1 + np.unpackbits(np.frombuffer(t, np.uint8), count=len(a)) for a, t in zip(at, pdf["twice"])]
        seen = np.bincount(np.concatenate(at), np.concatenate(hits), size) > 1
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "bitmap": [np.packbits(seen, bitorder="little").tobytes()]})

    at = _positions(F.col(digest_col), bits)
    packed = hashed.select(at[0].alias("p0"), at[1].alias("p1")).mapInArrow(run, "g long, at binary, twice binary")
    out = np.zeros((bits // size + 1) * size // 8, np.uint8)
    for g, bitmap in packed.groupBy("g").applyInPandas(merge, "g long, bitmap binary").toLocalIterator():
        out[g * size // 8:(g + 1) * size // 8] = np.frombuffer(bitmap, np.uint8)
    return out


def maybe_repeated(digest: Column, bitmap: np.ndarray, bits: int, spark) -> Column:
    """Second pass: true where all positions of a row are marked."""
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(p0: pd.Series, p1: pd.Series) -> pd.Series:
        marked = shared.value
        hit = np.ones(len(p0), bool)
        for p in (p0.to_numpy(), p1.to_numpy()):
            hit &= (marked[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(hit)

    at = _positions(digest, bits)
    return test(at[0], at[1])


def _hashed(docs: DataFrame, id_col: str, text_col: str):
    """Narrow table of digests (one scan of the texts), its filter and bits."""
    hashed = (narrow(docs, doc_id=id_col, text=text_col)
              .select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
              .withColumn("_row", F.monotonically_increasing_id()))
    hashed = materialise(hashed, "dedup-hashes")
    n_rows = hashed.count()
    bits = filter_bits(n_rows)
    return hashed, repeated_positions(hashed, "text_sha256", bits, n_rows), bits


def _groups(hashed: DataFrame, bitmap: np.ndarray, bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their filter answer, groups of the rows that shuffle)."""
    tested = materialise(hashed.withColumn("_maybe", maybe_repeated(
        F.col("text_sha256"), bitmap, bits, hashed.sparkSession)), "dedup-tested")
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "_row")
    # written, so that the join back reads two plain shuffles, whose hot
    # partitions adaptive execution can split
    groups = materialise(
        tested.where("_maybe").groupBy("text_sha256")
        .agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    return tested, groups


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    * texts are equal after normalising white space; null text equals empty
    * the row with the smallest doc_id stays (null ids last); of rows equal in
      text and id, one stays
    * empty table: no rows; further columns are not carried
    """
    tested, groups = _groups(*_hashed(docs, id_col, text_col))
    shuffled = tested.where("_maybe").join(groups, "text_sha256").select(
        "doc_id", F.col("_first.doc_id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("_first._row")).alias("kept"), "text_sha256")
    straight = tested.where(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    return straight.unionByName(shuffled)


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops, all columns kept.

    Rows that the filter calls unique go straight through.  The others meet
    the kept (id, digest) of their group; where equal rows repeat under one
    id, one of them stays (``dropDuplicates`` over the kept rows only)."""
    hashed, bitmap, bits = _hashed(docs, id_col, text_col)
    _, groups = _groups(hashed, bitmap, bits)
    sha, maybe, k_sha, k_id = (fresh(docs, c) for c in ("sha", "maybe", "k_sha", "k_id"))
    with_sha = docs.withColumn(sha, F.sha2(normalised(F.col(f"`{text_col}`")), 256))
    with_sha = with_sha.withColumn(maybe, maybe_repeated(F.col(sha), bitmap, bits, docs.sparkSession))
    keep = groups.select(F.col("text_sha256").alias(k_sha), F.col("_first.doc_id").alias(k_id))
    repeated = with_sha.where(F.col(maybe)).join(
        keep, (F.col(sha) == F.col(k_sha)) & F.col(f"`{id_col}`").eqNullSafe(F.col(k_id)),
        "left_semi").dropDuplicates([id_col, sha])
    return with_sha.where(~F.col(maybe)).unionByName(repeated).drop(sha, maybe)
