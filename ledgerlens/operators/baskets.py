"""Basket operators.

A basket is one receipt.  Receipts are small (a handful of lines), so grouping
by receipt never builds a large group; grouping by product uses partial
(map-side) aggregation before the shuffle, so a product that sits in a third
of all receipts still sends one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import spread


def multi_item_baskets(lines: DataFrame, basket: str = S.NOTA, item: str = S.NAME) -> DataFrame:
    """Keep the lines of receipts whose **row count** of non-null
    items is > 1.  Not distinct: a receipt with one product on two lines
    stays (and later becomes a one-item set).

    A count over the receipt: one read of the ledger and one shuffle."""
    w = Window.partitionBy(basket)
    return (lines.where(F.col(basket).isNotNull()).withColumn("_n", F.count(item).over(w))
            .where(F.col("_n") > 1).drop("_n"))


def multi_row_receipts(lines: DataFrame, basket: str = S.NOTA) -> DataFrame:
    """All lines of receipts that occur on more than one row."""
    w = Window.partitionBy(basket)
    return (lines.where(F.col(basket).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(w))
            .where(F.col("_n") > 1).drop("_n"))


def multi_item_sets(lines: DataFrame, basket: str = S.NOTA, item: str = S.NAME,
                    items_col: str = "items") -> DataFrame:
    """C11 and A3 in one aggregate, for the miner: the item sets of receipts
    with more than one non-null item row."""
    return (lines.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).groupBy(basket)
            .agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias(items_col),
                 F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > 1).drop("_n"))


def baskets_containing(lines: DataFrame, predicate: Column, basket: str = S.NOTA) -> DataFrame:
    """All lines of receipts where at least one line satisfies
    ``predicate`` (a group filter: one read of the lines and one shuffle by
    receipt; lines without a receipt are in none)."""
    has = F.bool_or(F.coalesce(predicate, F.lit(False))).over(Window.partitionBy(basket))
    return lines.where(F.col(basket).isNotNull()).withColumn("_has", has).where("_has").drop("_has")


def flagged_item_sets(lines: DataFrame, predicate: Column, basket: str = S.NOTA, item: str = S.NAME,
                      items_col: str = "items") -> DataFrame:
    """C11, J5 and A3 in one aggregate, for the miner: the item sets of receipts
    with more than one non-null item row and a line that satisfies
    ``predicate``."""
    return (lines.where(F.col(basket).isNotNull()).groupBy(basket)
            .agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias(items_col),
                 F.count(item).alias("_n"), F.bool_or(F.coalesce(predicate, F.lit(False))).alias("_has"))
            .where((F.col("_n") > 1) & F.col("_has")).drop("_n", "_has"))


def baskets(lines: DataFrame, basket: str = S.NOTA, item: str = S.NAME,
            items_col: str = "items") -> DataFrame:
    """A3: distinct non-null items per receipt, as an array (a set: the
    miner rejects repeated items)."""
    return (lines.where(F.col(item).isNotNull()).groupBy(basket)
            .agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias(items_col)))


def sold_together(lines: DataFrame, basket: str = S.NOTA, item: str = S.NAME) -> DataFrame:
    """A4: items that occur in at least one receipt with more than one
    **distinct** item (contrast C11).

    One aggregate per receipt, over receipts dealt out by ``spread``: a task
    holds its share of the lines once."""
    held = lines.where(F.col(item).isNotNull() & F.col(basket).isNotNull()).select(basket, item)
    sets = spread(held, basket).groupBy(basket).agg(F.collect_set(item).alias("_set")).where(F.size("_set") > 1)
    return sets.select(F.explode("_set").alias(item)).distinct()


def receipts_per_product(lines: DataFrame, basket: str = S.NOTA, item: str = S.NAME) -> DataFrame:
    """A5: number of distinct receipts per product."""
    return (lines.where(F.col(item).isNotNull()).groupBy(item)
            .agg(F.countDistinct(basket).alias("n_receipts")))


def basket_size_buckets(lines: DataFrame, by: str | None = S.SOURCE, basket: str = S.NOTA) -> DataFrame:
    """Receipts with 1, 2 and > 2 rows, and their percentages, per
    ``by`` (a source file) or overall when ``by`` is None.

    Rows are counted per receipt *within* a file, as the per-file count did.
    """
    keys = [by, basket] if by else [basket]
    per = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    grp = [by] if by else []
    agg = (per.groupBy(*grp) if grp else per.groupBy()).agg(
        F.sum(F.when(F.col("_n") == 1, 1).otherwise(0)).cast("long").alias("n_one"),
        F.sum(F.when(F.col("_n") == 2, 1).otherwise(0)).cast("long").alias("n_two"),
        F.sum(F.when(F.col("_n") > 2, 1).otherwise(0)).cast("long").alias("n_more"),
    )
    tot = F.col("n_one") + F.col("n_two") + F.col("n_more")
    return (agg.withColumn("pct_one", F.col("n_one") * 100.0 / tot)
            .withColumn("pct_two", F.col("n_two") * 100.0 / tot)
            .withColumn("pct_more", F.col("n_more") * 100.0 / tot))


def basket_width_histogram(lines: DataFrame, cap: int = S.HISTOGRAM_CAP,
                           basket: str = S.NOTA, item: str = S.NAME) -> DataFrame:
    """Receipts by number of distinct products, bins 1..min(cap, max).

    The last bin is closed: width ``top + 1`` lands in bin ``top`` (top =
    min(cap, max width)); wider receipts are not counted.
    """
    widths = (lines.where(F.col(item).isNotNull()).groupBy(basket)
              .agg(F.countDistinct(item).alias("width")))
    top = widths.agg(F.least(F.max("width"), F.lit(cap)).alias("_top"))
    w = widths.crossJoin(F.broadcast(top))
    binned = w.where(F.col("width") <= F.col("_top") + 1).withColumn(
        "bin", F.when(F.col("width") == F.col("_top") + 1, F.col("_top")).otherwise(F.col("width")))
    return binned.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_receipts"))


def product_pairing_stats(lines: DataFrame, basket: str = S.NOTA, item: str = S.NAME) -> DataFrame:
    """On multi-row receipts (C12), per product: the number of distinct
    receipt item-sets that contain it, its row occurrences, and occurrences
    / distinct receipts * 100.

    The ledger is reduced once to the items of each multi-row receipt, dealt
    out by ``spread``, and that table is written once: the item-sets, the
    occurrences and the receipt total all read it.  Item-sets are
    de-duplicated before the explode, so identical receipts collapse before
    any per-product work."""
    from ..session import materialise
    held = spread(lines.where(F.col(basket).isNotNull()).select(basket, item), basket)
    multi = materialise(held.groupBy(basket).agg(F.count(F.lit(1)).alias("_rows"), F.collect_list(item).alias("_items"))
                        .where((F.col("_rows") > 1) & (F.size("_items") > 0)).select("_items"), "multi_row_receipts")
    sets = multi.select(F.array_sort(F.array_distinct("_items")).alias("_set")).distinct()
    per_set = sets.select(F.explode("_set").alias(item)).groupBy(item).agg(
        F.count(F.lit(1)).alias("n_unique_sets"))
    occ = multi.select(F.explode("_items").alias(item)).groupBy(item).agg(F.count(F.lit(1)).alias("occurrences"))
    total = multi.agg(F.count(F.lit(1)).alias("_total"))
    out = per_set.join(occ, item).crossJoin(F.broadcast(total))
    return out.select(item, "n_unique_sets", "occurrences",
                      (F.col("occurrences") * 100.0 / F.col("_total")).alias("pct_occurrence"))


def basket_length_summary(lines: DataFrame, basket: str = S.NOTA) -> DataFrame:
    """A10: count, mean, sample std, min, linear-interpolated quartiles and
    max of rows per receipt."""
    per = lines.groupBy(basket).agg(F.count(F.lit(1)).alias("_len"))
    q = F.percentile(F.col("_len"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return per.agg(
        F.count(F.lit(1)).alias("count"), F.avg("_len").alias("mean"),
        F.stddev_samp("_len").alias("std"), F.min("_len").cast("long").alias("min"),
        q.alias("_q"), F.max("_len").cast("long").alias("max"),
    ).select("count", "mean", "std", "min",
             F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"),
             F.col("_q")[2].alias("q75"), "max")
