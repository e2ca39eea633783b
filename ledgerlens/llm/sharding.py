"""Reproducible shuffle and sharding by a Feistel permutation (native).

Every row gets a global row number; a keyed Feistel network over the smallest
power of two that covers N, with cycle walking back into [0, N), permutes the
numbers.  ``shard = p mod S`` and ``slot = p div S`` are then computable from
the row number alone, shard sizes differ by at most one (law ``rows``) and
slots have no gaps.  DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, narrow

ROUNDS = 6
#: Cycle-walking steps.  The domain is under 2 N (N >= 2), so a walk of this
#: length is missed with probability below 2**-96 per row; a miss raises.
MAX_WALK = 96
#: Buckets in which rows are numbered; their counts are the only data that
#: meets in one task.
BUCKETS = 4096


def _permute_sql(x: str, n: str, seed: int, rounds: int, inverse: bool = False) -> str:
    """One pass of the network over ``bits`` bits as SQL.  Rounds alternate
    between the upper ``bits div 2`` and the lower remaining bits, so the two
    halves may differ in width and every round is its own inverse."""
    bits = f"greatest(2, length(bin({n} - 1)))"
    low = f"({bits} - {bits} div 2)"
    low_mask = f"(shiftleft(1L, {low}) - 1L)"
    high_mask = f"(shiftleft(1L, {bits} div 2) - 1L)"
    order = f"sequence({rounds - 1}, 0)" if inverse else f"sequence(0, {rounds - 1})"
    return (f"aggregate({order}, {x}, (v, i) -> if(i % 2 = 0, "
            f"v ^ shiftleft(xxhash64(v & {low_mask}, i, {seed}L) & {high_mask}, {low}), "
            f"v ^ (xxhash64(shiftright(v, {low}), i, {seed}L) & {low_mask})))")


def _walked(x: str, n: str, seed: int, rounds: int, inverse: bool) -> Column:
    first = _permute_sql(x, n, seed, rounds, inverse)
    again = _permute_sql("p", n, seed, rounds, inverse)
    return F.expr(
        f"aggregate(sequence(1, {MAX_WALK}), {first}, (p, w) -> if(p < {n}, p, {again}), "
        f"p -> if(p < {n}, p, raise_error('cycle walk too long: choose another seed')))")


def permuted(row: str, n: str, seed: int = 0, rounds: int = ROUNDS) -> Column:
    """Position of row number column ``row`` in the shuffle of ``n`` rows."""
    return _walked(row, n, seed, rounds, inverse=False)


def row_at(position: str, n: str, seed: int = 0, rounds: int = ROUNDS) -> Column:
    """Row number at a position (``slot * shards + shard``): the inverse."""
    return _walked(position, n, seed, rounds, inverse=True)


def number_rows(df: DataFrame, order: list[str], row_col: str = "row_number",
                total_col: str = "n_rows", buckets: int = BUCKETS) -> DataFrame:
    """Gapless global row numbers from 0, plus the number of rows.

    Rows are hashed on ``order`` into buckets, numbered inside them in that
    order, and shifted by the counts of the earlier buckets.  The numbering
    depends on the values only, never on files or partitions.  One shuffle of
    the given (narrow) rows, written once; rows equal in all ``order`` columns
    are interchangeable."""
    w = Window.partitionBy("_bucket").orderBy(*order)
    local = (df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
             .withColumn("_local", F.row_number().over(w).cast("long")))
    local = materialise(local, "numbered")
    counts = local.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_count"))
    w_all = Window.orderBy("_bucket")  # at most `buckets` rows
    offsets = counts.select(
        "_bucket",
        (F.sum("_count").over(w_all) - F.col("_count")).alias("_offset"),
        F.sum("_count").over(w_all.rowsBetween(Window.unboundedPreceding,
                                               Window.unboundedFollowing)).alias(total_col))
    return (local.join(F.broadcast(offsets), "_bucket")
            .withColumn(row_col, F.col("_offset") + F.col("_local") - 1)
            .drop("_bucket", "_local", "_offset", "_count"))


def feistel_shards(docs: DataFrame, shards: int = 16, seed: int = 0, *, id_col: str = "doc_id",
                   text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot,
    grown_shard, row_number, n_rows.

    * null text: size 1, CRC of the empty text; null id: an id like any other
    * repeated rows and repeated ids: one output row each, own slots
    * empty table: no rows; one row: shard 0, slot 0
    * further columns are not carried; the text never leaves the scan
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = narrow(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered = number_rows(base, ["doc_id", "text_crc32", "size"])
    at = numbered.withColumn("_p", permuted("row_number", "n_rows", seed, rounds))
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod(F.col("_p"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_p div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number", "n_rows")
