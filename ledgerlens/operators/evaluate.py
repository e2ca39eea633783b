"""Evaluation against owner labels.

Rankings over *all* rules are global orders; they are computed with a
distributed prefix sum (``global_rank``), never with an un-partitioned
window.  Per-sheet questions are answered with aggregates and a broadcast of
one row per sheet (the grid size), not with per-sheet windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.ordered import PagedTable, global_rank, grouped_rank


def support_order() -> list:
    """O1: support desc; the rule key breaks ties (ours)."""
    return [F.col("support").desc(), F.col("rule_key")]


def precision_at_k(rules: DataFrame, order=None, validity: str = "validity") -> DataFrame:
    """For every k = 1..N under ``order``: valid among the top k / k.
    Rows without a label (null validity) are left out."""
    order = order or support_order()
    labelled = rules.where(F.col(validity).isNotNull())
    ranked = global_rank(labelled, order, rank_col="k", running={"valid_at_k": F.col(validity)})
    return ranked.select("k", F.col("valid_at_k").cast("long").alias("valid_at_k"),
                         (F.col("valid_at_k") / F.col("k")).alias("precision"))


def precision_curves(rules: DataFrame, by: Sequence[str], order=None, validity: str = "validity") -> DataFrame:
    """W2, one curve per group (a file, a sheet, a platform): for every
    k = 1..n of the group under ``order`` (a total order within the group)
    the valid ones among its top k, and their share.  A segmented prefix sum,
    so a group with most of the rules is still spread over tasks."""
    order = order or support_order()
    labelled = rules.where(F.col(validity).isNotNull())
    ranked = grouped_rank(labelled, by, order, rank_col="k", running={"valid_at_k": F.col(validity)})
    return ranked.select(*by, "k", F.col("valid_at_k").cast("long").alias("valid_at_k"),
                         (F.col("valid_at_k") / F.col("k")).alias("precision"))


def curve_points(curve: DataFrame, parts: int = 10) -> DataFrame:
    """Every max(1, N // parts)-th point starting at k = 1 (10 for the
    printed points, 7 for the labelled ones)."""
    n = curve.agg(F.max("k").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(parts)))
    return (curve.crossJoin(F.broadcast(n)).where(((F.col("k") - 1) % step) == 0).drop("_n"))


def precision_at(pairs: DataFrame, ks: Sequence[int] = S.PAIR_PRECISION_KS,
                 order=None, validity: str = "valid") -> DataFrame:
    """Precision at fixed k over pairs ranked by score desc; divides by
    k even when fewer than k rows exist.  Top-k is a distributed
    take-ordered (each task keeps its best max(ks) rows)."""
    order = order or [F.col("score").desc(), F.col("id_1"), F.col("id_2")]
    kmax = max(ks)
    top = global_rank(pairs.orderBy(*order).limit(kmax), order, rank_col="_r",
                      running={"_cum": F.col(validity)}, partitions=1)
    spark = pairs.sparkSession
    kdf = spark.createDataFrame([(int(k),) for k in ks], "k int")
    best = top.select("_r", "_cum")
    last = best.agg(F.max("_r").alias("_last"))
    joined = (kdf.crossJoin(F.broadcast(last))
              .withColumn("_at", F.least(F.col("k").cast("long"), F.col("_last")))
              .join(best, F.col("_r") == F.col("_at"), "left"))
    return joined.select("k", F.coalesce(F.col("_cum"), F.lit(0.0)).cast("long").alias("valid_at_k"),
                         (F.coalesce(F.col("_cum"), F.lit(0.0)) / F.col("k")).alias("precision"))


def _sheet_totals(rules: DataFrame, validity: str) -> DataFrame:
    """One row per sheet: totals, and the first invalid rule by support desc
    (null if there is none), in one aggregate."""
    at = F.struct(-F.col("support"), F.col("rule_key"))
    return rules.groupBy("sheet").agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.coalesce(F.sum(validity), F.lit(0)).cast("long").alias("valid_rules"),
        F.min(F.when(F.col(validity) == 0, at)).alias("_first"))


def _before_first_invalid(rules: DataFrame, totals: DataFrame, validity: str) -> DataFrame:
    """``totals`` (a handful of sheets, broadcast) with the number of valid
    rules before the first invalid one."""
    at = F.struct(-F.col("support"), F.col("rule_key"))
    before = F.col("_first").isNull() | (at < F.col("_first"))
    keep = [c for c in totals.columns if c not in ("sheet", "_first")]
    return (rules.join(F.broadcast(totals), "sheet").groupBy("sheet").agg(
        *[F.first(c).alias(c) for c in keep],
        F.sum(F.when(before & (F.col(validity) == 1), 1).otherwise(0)).cast("long").alias("rules_before_first_zero")))


def rules_before_first_invalid(rules: DataFrame, validity: str = "validity") -> DataFrame:
    """Per sheet, by support desc (ties: rule key), the number of valid
    rules before the first invalid one (all valid rules when none is)."""
    totals = _sheet_totals(rules, validity)
    return _before_first_invalid(rules, totals, validity).select("sheet", "rules_before_first_zero")


def rule_quality(rules: DataFrame, validity: str = "validity") -> DataFrame:
    """Per sheet: total rules, valid rules, validity %, rules before
    the first invalid one and its %, with the support and confidence parsed
    from the label (the grid order: both descending)."""
    out = _before_first_invalid(rules, _sheet_totals(rules, validity), validity)
    return out.select(
        "sheet", "total_rules", "valid_rules",
        (F.col("valid_rules") / F.col("total_rules") * 100.0).alias("validity_percentage"),
        "rules_before_first_zero",
        (F.col("rules_before_first_zero") / F.col("total_rules") * 100.0).alias("percentage_rules_before_zero"),
        F.regexp_extract("sheet", r"Sup(\d+\.?\d*)", 1).cast("double").alias("grid_support"),
        F.regexp_extract("sheet", r"Conf(\d+\.?\d*)", 1).cast("double").alias("grid_confidence"))


def range_validity(pairs: DataFrame, band_col: str = "band", validity: str = "valid") -> DataFrame:
    """Per band: entries, invalid count, valid %."""
    return pairs.groupBy(band_col).agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.sum(F.when(F.col(validity) == 0, 1).otherwise(0)).cast("long").alias("invalid_count")).withColumn(
        "valid_percentage", (F.col("total_entries") - F.col("invalid_count")) / F.col("total_entries") * 100.0)


def top_k(df: DataFrame, k: int, order) -> DataFrame:
    """O3: the first k rows under ``order`` (distributed take-ordered)."""
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, n: int, order, rows: int = S.PAGE_ROWS) -> DataFrame:
    """Page ``n`` (1-based) of ``rows`` rows with their row numbers: a
    distributed take-ordered up to the page's end, then the page's rows.  For
    the first pages of a table that is read once; ``paged`` serves any page."""
    skip = (n - 1) * rows
    pg = df.orderBy(*order).offset(skip).limit(rows)
    return pg.withColumn("_row", F.row_number().over(Window.orderBy(*order)).cast("long") + F.lit(skip))


def paged(df: DataFrame, order, rows: int = S.PAGE_ROWS) -> PagedTable:
    """``df`` written once in page order; ``.pages(n, ...)`` reads only the
    range partitions that hold the pages, late ones as cheaply as the first."""
    return PagedTable(df, order, rows)


def page_totals(df: DataFrame, rows: int = S.PAGE_ROWS) -> DataFrame:
    """Total rows and pages."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn(
        "total_pages", F.ceil(F.col("total_rows") / F.lit(rows)).cast("long"))
