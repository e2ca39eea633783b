"""Order-dependent building blocks that never funnel data into one task.

* ``global_rank``  – 1-based position over a total order, computed as
  range partitions + per-partition offsets (a distributed prefix sum).
* ``grouped_rank`` – the same, starting anew at every group (a segmented
  prefix sum): a group may span any number of range partitions.
* ``PagedTable``   – rows written once in a total order, with an index of the
  range partitions, so any page is read from the one or two that hold it.
* ``top_n_per_group`` – exact top-n per group in two stages, so a group that
  holds a third of all rows is first cut down inside many salted sub-groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def _num_partitions(df: DataFrame, rows_hint: int | None = None) -> int:
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, n)


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "k",
                running: dict[str, Column] | None = None,
                partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` = position 1..N under ``order`` (must be a total
    order), plus running sums ``running[name]`` of the given expressions.

    Plan: range-partition on the order, sort inside partitions, tag every row
    with (partition, local index), and write that once as a table in the
    shared checkpoint folder so a lost executor cannot re-sample different
    ranges.  Per
    partition totals (one row per partition) give the offsets; they are the
    only data that meets in one place and their size is the partition count.
    """
    running = running or {}
    p = partitions or _num_partitions(df)
    tmp_vals = {f"_rv_{name}": expr.cast("double") for name, expr in running.items()}
    base = df
    for name, expr in tmp_vals.items():
        base = base.withColumn(name, expr)
    staged = (base.repartitionByRange(p, *order)
              .sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright(F.col("_mid"), _LOCAL_BITS))
              .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    # (partition, local index) are stored columns of the written table, so
    # they cannot change if a task is re-run
    staged = materialise(staged, "ranked")
    aggs = [F.count(F.lit(1)).alias("_cnt")] + [F.sum(c).alias(f"_tot{c}") for c in tmp_vals]
    totals = staged.groupBy("_pid").agg(*aggs)
    w_all = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(w_all), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_tot{c}").over(w_all), F.lit(0.0)).alias(f"_off{c}") for c in tmp_vals],
    )
    out = staged.join(F.broadcast(offsets), "_pid")
    out = out.withColumn(rank_col, (F.col("_off") + F.col("_loc") + 1).cast("long"))
    if tmp_vals:
        w_local = Window.partitionBy("_pid").orderBy("_loc").rowsBetween(Window.unboundedPreceding, 0)
        for name, tmp in zip(running, tmp_vals):
            out = out.withColumn(name, F.col(f"_off{tmp}") + F.sum(tmp).over(w_local))
    drop = ["_mid", "_pid", "_loc", "_off"] + list(tmp_vals) + [f"_off{c}" for c in tmp_vals]
    return out.drop(*drop)


def grouped_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], rank_col: str = "k",
                 running: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` = position 1..n within the row's group under ``order``
    (a total order within the group), plus running sums ``running[name]``
    that restart with the group.  Null group values are values like any other.

    Plan: range-partition on (group, order) and write that once, as in
    ``global_rank``.  A group lies in consecutive partitions, and only the
    first group of a partition can have begun in an earlier one.  So every
    (partition, group) is ranked by itself, and what came before is added from
    a table of offsets that has at most one row per partition (broadcast).  A
    group with a third of all rows is spread over a third of the partitions;
    no window is keyed on the group alone, but for the offsets' own, over one
    row per (partition, group)."""
    running = running or {}
    sums = {f"_rv_{name}": expr.cast("double") for name, expr in running.items()}
    keys = {f"_g{i}": F.col(c) for i, c in enumerate(group)}
    by = [F.col(g) for g in keys]
    staged = materialise(
        df.withColumns({**sums, **keys})
        .repartitionByRange(partitions or _num_partitions(df), *by, *order).sortWithinPartitions(*by, *order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright(F.col("_mid"), _LOCAL_BITS)), "group-ranked")
    local = Window.partitionBy("_pid", *keys).orderBy("_mid")
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    ranked = staged.withColumns({rank_col: F.row_number().over(local).cast("long"),
                                 **{name: F.sum(tmp).over(upto) for name, tmp in zip(running, sums)}})
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = staged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_cnt"),
                                               *[F.sum(c).alias(f"_tot{c}") for c in sums])
    offsets = totals.select(
        F.col("_pid").alias("_opid"), *[F.col(g).alias(f"_o{g}") for g in keys], F.sum("_cnt").over(before).alias("_off"),
        *[F.coalesce(F.sum(f"_tot{c}").over(before), F.lit(0.0)).alias(f"_off{c}") for c in sums]
    ).where("_off IS NOT NULL")
    same = F.col("_pid") == F.col("_opid")
    for g in keys:
        same &= F.col(g).eqNullSafe(F.col(f"_o{g}"))
    out = ranked.join(F.broadcast(offsets), same, "left")
    out = out.withColumns({rank_col: F.col(rank_col) + F.coalesce("_off", F.lit(0)),
                           **{name: F.col(name) + F.coalesce(f"_off{tmp}", F.lit(0.0))
                              for name, tmp in zip(running, sums)}})
    return out.select(*df.columns, rank_col, *running)


class PagedTable:
    """``df`` written once in range partitions of ``order`` (a total order),
    one folder each; ``pages(...)`` reads only the folders that hold the rows.

    The index (a partition's first row number and its rows) has one entry per
    partition.  Every row carries its place within its partition, so a page is
    a filter: no sort, and nothing depends on the order of files."""

    def __init__(self, df: DataFrame, order: Sequence[Column], rows: int, partitions: int | None = None,
                 row_col: str = "row_no", page_col: str = "page_no"):
        from ..session import materialised_dir
        self._spark, self.rows, self._row, self._page = df.sparkSession, rows, row_col, page_col
        self._columns = df.columns
        self.path = f"{materialised_dir(self._spark)}/pages-{uuid.uuid4().hex}"
        staged = (df.repartitionByRange(partitions or _num_partitions(df), *order).sortWithinPartitions(*order)
                  .withColumn("_mid", F.monotonically_increasing_id())
                  .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
                  .withColumn("_pid", F.shiftright(F.col("_mid"), _LOCAL_BITS)).drop("_mid"))
        staged.write.partitionBy("_pid").parquet(self.path)
        self._schema = staged.schema
        counts = self._table().groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).orderBy("_pid").collect()
        self.index, self.total_rows = [], 0
        for r in counts:
            self.index.append((r["_pid"], self.total_rows, r["n"]))
            self.total_rows += r["n"]
        self.total_pages = -(-self.total_rows // rows)

    def _table(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self.path)

    def pages(self, *numbers: int) -> DataFrame:
        """The rows of the pages (1-based; none beyond the last) with their row
        and page numbers."""
        parts = []
        for page in sorted(set(numbers)):
            first, last = (page - 1) * self.rows, page * self.rows
            for pid, start, n in self.index:
                if start < last and first < start + n:
                    parts.append((F.col("_pid") == pid) & (F.col("_loc") >= first - start) & (F.col("_loc") < last - start))
        starts = {pid: start for pid, start, _ in self.index}
        wanted = reduce(or_, parts, F.lit(False))
        held = sorted({pid for page in numbers for pid, start, n in self.index
                       if start < page * self.rows and (page - 1) * self.rows < start + n})
        offset = reduce(lambda c, pid: c.when(F.col("_pid") == pid, F.lit(starts[pid])), held,
                        F.when(F.lit(False), F.lit(0)))
        row = (offset + F.col("_loc") + 1).cast("long")
        return (self._table().where(F.col("_pid").isin(held) & wanted)
                .select(*self._columns, row.alias(self._row),
                        (F.floor((row - 1) / self.rows) + 1).cast("long").alias(self._page)))


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                    salt_buckets: int = 16, salt_key: Column | None = None,
                    rank_col: str | None = None) -> DataFrame:
    """Exact top-n rows per group under ``order`` (a total order).

    Stage 1 ranks inside (group, salt) sub-groups and keeps n per sub-group;
    stage 2 ranks the at most ``n * salt_buckets`` survivors per group.  The
    top n of a union is inside the union of the per-part top n, so this is
    exact, and no task ever holds more than a 1/salt share of a hot group.
    """
    salt = F.pmod(F.xxhash64(salt_key if salt_key is not None else F.struct(*df.columns)),
                  F.lit(salt_buckets))
    staged = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    staged = staged.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n)
    w2 = Window.partitionBy(*group).orderBy(*order)
    rc = rank_col or "_r2"
    out = staged.withColumn(rc, F.row_number().over(w2)).where(F.col(rc) <= n)
    out = out.drop("_salt", "_r1")
    return out if rank_col else out.drop("_r2")
