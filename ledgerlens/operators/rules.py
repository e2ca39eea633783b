"""Association rules.

Itemsets are counted level by level over the baskets, with joins and map-side
counts (``_itemsets``).  A parameter grid is mined **once** at its loosest cell; every other cell is a filter on integer support counts
and confidence, which is exactly what a separate fit per cell would return
(it keeps itemsets with count >= ceil(s * n) and rules with confidence >=
c, and a rule's metrics do not depend on the thresholds).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.columns import rule_key, sheet_label
from ..session import materialise, materialise_counted


def rule_params(platform: str, kind: str = "all") -> tuple[float, float]:
    """M3: preset (min support, min confidence) of a platform."""
    if kind == "deadstock":
        return S.DEADSTOCK_RULE_PARAMS.get(platform, S.DEADSTOCK_RULE_PARAMS_DEFAULT)
    return S.RULE_PARAMS.get(platform, S.RULE_PARAMS_DEFAULT)


def _fit(baskets: DataFrame, min_support: float, min_conf: float,
         items_col: str = "items", num_partitions: int | None = None):
    """MLlib FP-Growth over a written basket table, which the miner's sets
    are checked against.  The number of FP-tree
    groups defaults to the session's shuffle parallelism (the cluster's
    configured width), and a table with fewer file splits than cores is
    spread first, so building the conditional trees uses every core.  On
    large inputs neither changes anything.  (The split count of a written
    table is known without running anything.)"""
    spark = baskets.sparkSession
    data = baskets.select(items_col)
    cores = spark.sparkContext.defaultParallelism
    if data.rdd.getNumPartitions() < cores:
        data = data.repartition(cores)
    if not num_partitions:
        num_partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fp = FPGrowth(itemsCol=items_col, minSupport=float(min_support),
                  minConfidence=float(min_conf)).setNumPartitions(int(num_partitions))
    return fp.fit(data)


def rules_from_itemsets(itemsets: DataFrame, n_baskets: DataFrame, min_conf: float) -> DataFrame:
    """M1: single-consequent association rules of frequent itemsets
    (items sorted, freq) — for every itemset X of size > 1 and item c in X,
    ``X - {c} -> c`` with confidence freq(X) / freq(X - {c}) (kept when
    >= ``min_conf``), lift = confidence / (freq({c}) / n) and support =
    freq(X) / n, n = number of baskets (a one-row frame).  The antecedent
    is itself frequent, so it is found by an equi-join on the sorted item
    array; each consequent's own count by a join on the item."""
    ante = itemsets.select(F.col("items").alias("antecedent"), F.col("freq").alias("_fa"))
    single = itemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("_c"),
                                                         F.col("freq").alias("_fc"))
    cand = (itemsets.where(F.size("items") > 1)
            .select("items", "freq", F.explode("items").alias("_c"))
            .withColumn("antecedent", F.array_remove("items", F.col("_c"))))
    conf = F.col("freq").cast("double") / F.col("_fa").cast("double")
    r = (cand.join(ante, "antecedent").join(single, "_c")
         .crossJoin(F.broadcast(n_baskets.select(F.col(n_baskets.columns[0]).cast("double").alias("_n"))))
         .withColumn("confidence", conf)
         .where(F.col("confidence") >= F.lit(float(min_conf))))
    return r.select(
        "antecedent", F.array(F.col("_c")).alias("consequent"), "confidence",
        (F.col("confidence") / (F.col("_fc").cast("double") / F.col("_n"))).alias("lift"),
        (F.col("freq").cast("double") / F.col("_n")).alias("support"),
    ).withColumn("rule_key", rule_key("antecedent", "consequent"))


def mine_rules(baskets: DataFrame, min_support: float, min_conf: float,
               items_col: str = "items", num_partitions: int | None = None) -> DataFrame:
    """M1: rules (antecedent, consequent, confidence, lift, support) with
    both sides sorted and a canonical ``rule_key``.  Support counts compare
    with ``ceil(min_support * n)``; confidence with ``>=``.  ``n`` counts
    every basket passed in, including one-item sets.

    The baskets are written once as a table (every level of the miner and
    ``n`` read them), the frequent itemsets are written as a table too, and the
    rules are derived from that table."""
    return _mine(materialise(baskets.select(items_col), "baskets"), min_support, min_conf,
                 items_col, num_partitions)


def _mine(baskets: DataFrame, min_support: float, min_conf: float, items_col: str,
          num_partitions: int | None) -> DataFrame:
    """``mine_rules`` over baskets that are already a written table."""
    itemsets = _itemsets(baskets, min_support, items_col, num_partitions)
    n = baskets.agg(F.count(F.lit(1)).alias("_n"))
    return rules_from_itemsets(itemsets, n, min_conf)


def frequent_itemsets(baskets: DataFrame, min_support: float,
                      items_col: str = "items", num_partitions: int | None = None) -> DataFrame:
    """M2: frequent itemsets (items sorted) and their counts (the baskets are
    written once first: every level reads them)."""
    return _itemsets(materialise(baskets.select(items_col), "baskets"), min_support, items_col,
                     num_partitions)


#: Itemsets of one size that are broadcast to the baskets (more are joined).
BROADCAST_SETS = 500_000


def _itemsets(baskets: DataFrame, min_support: float, items_col: str,
              num_partitions: int | None) -> DataFrame:
    """``frequent_itemsets`` over baskets that are already a written table.

    Level by level, shortest sets first: a frequent set of k items, the items
    in order, is a frequent set of k - 1 items and a later one.  Each basket
    walks down the levels found so far (joins on the set's number and the next
    item, no shuffle of baskets) and counts, map-side first, what its sets
    become with one more item; so what a level shuffles are its counts.  Levels
    end with the longest frequent set.  ``num_partitions`` is the width of the
    counts' shuffle (default: the session's)."""
    spark = baskets.sparkSession
    # no set may hold an item twice
    data = baskets.select(F.array_sort(F.array_distinct(items_col)).alias("_rest"))
    cores = spark.sparkContext.defaultParallelism
    if data.rdd.getNumPartitions() < cores:
        data = data.repartition(cores)
    total, repeated = baskets.agg(
        F.count(F.lit(1)), F.coalesce(F.bool_or(F.size(items_col) != F.size(F.array_distinct(items_col))), F.lit(False))).first()
    if repeated:
        raise ValueError("items in a basket must be unique")
    least = math.ceil(float(min_support) * total)

    def next_items(rows: DataFrame) -> DataFrame:
        """One row per item still to come, with the items after it."""
        return (rows.select("_set", "_rest", F.posexplode("_rest").alias("_pos", "_item"))
                .select("_set", "_item", F.expr("slice(_rest, _pos + 2, size(_rest))").alias("_rest")))

    def sized(sets: DataFrame, number: int) -> DataFrame:
        return F.broadcast(sets) if number <= BROADCAST_SETS else sets

    def counted(keys: DataFrame, *by: str) -> DataFrame:
        found = (keys.repartition(int(num_partitions), *by) if num_partitions else keys)
        return found.groupBy(*by).agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= F.lit(least))

    rows = data.select(F.lit(0).cast("long").alias("_set"), "_rest")
    single, n_single = materialise_counted(
        counted(next_items(rows).select("_item"), "_item").select(
            "_item", "freq", F.monotonically_increasing_id().alias("_id")), "itemsets_1")
    levels = [single.select(F.array("_item").alias("items"), "freq")]
    items = sized(single.select("_item", F.col("_id").alias("_next")), n_single)
    rows = next_items(rows).join(items, "_item").select(F.col("_next").alias("_set"), "_rest")
    named, n_sets = single.select(F.col("_id").alias("_set"), F.array("_item").alias("items")), n_single
    while n_sets:
        rows = rows.where(F.size("_rest") > 0)
        longer = next_items(rows).join(items, "_item").select("_set", F.col("_next").alias("_with"), "_rest")
        found, n_found = materialise_counted(
            counted(longer.select("_set", "_with"), "_set", "_with")
            .join(sized(named, n_sets), "_set").join(items, F.col("_with") == F.col("_next"))
            .select("_set", "_with", F.concat("items", F.array("_item")).alias("items"), "freq",
                    F.monotonically_increasing_id().alias("_id")), f"itemsets_{len(levels) + 1}")
        if not n_found:
            break
        levels.append(found.select("items", "freq"))
        rows = (longer.join(sized(found.select("_set", "_with", "_id"), n_found), ["_set", "_with"])
                .select(F.col("_id").alias("_set"), "_rest"))
        named, n_sets = found.select(F.col("_id").alias("_set"), "items"), n_found
    return reduce(DataFrame.unionByName, levels).select("items", F.col("freq").cast("long").alias("freq"))


def grid_dim(spark, supports: Sequence[float], confs: Sequence[float]) -> DataFrame:
    """The grid as a small table: label, support, confidence and grid
    order (support is the outer loop).  Its size is the grid's, so it is
    always broadcast."""
    rows = []
    for i, s in enumerate(supports):
        for j, c in enumerate(confs):
            rows.append((sheet_label(s, c), float(s), float(c), i * len(confs) + j))
    schema = T.StructType([T.StructField("sheet", T.StringType()),
                           T.StructField("min_support", T.DoubleType()),
                           T.StructField("min_confidence", T.DoubleType()),
                           T.StructField("grid_ord", T.IntegerType())])
    return spark.createDataFrame(rows, schema)


def mine_grid(baskets: DataFrame, supports: Sequence[float], confs: Sequence[float],
              items_col: str = "items", num_partitions: int | None = None) -> DataFrame:
    """Rules of every (support x confidence) cell, labelled
    ``Sup{s}_Conf{c}_Rules``, from one run of the miner at the loosest cell.
    The concatenation of the per-cell runs (U2) is the rules x grid join
    itself: one row per (cell, rule)."""
    spark = baskets.sparkSession
    # The baskets feed both the miner and n, the mined rules feed every cell:
    # both are written once to the checkpoint folder instead of being
    # recomputed from the ledger for each use.
    baskets = materialise(baskets.select(items_col), "baskets")
    rules = _mine(baskets, min(supports), min(confs), items_col, num_partitions)
    n = baskets.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    grid = grid_dim(spark, supports, confs)
    cells = grid.crossJoin(n).withColumn("_min_count", F.ceil(F.col("min_support") * F.col("_n")))
    out = rules.crossJoin(F.broadcast(cells)).where(
        (F.round(F.col("support") * F.col("_n")) >= F.col("_min_count"))
        & (F.col("confidence") >= F.col("min_confidence")))
    return out.drop("_n", "_min_count", "min_support", "min_confidence")


def rules_touching(rules: DataFrame, item_category: DataFrame, label: str = S.CAT_DEADSTOCK,
                   item: str = "item", category: str = "category") -> DataFrame:
    """M7: rules with at least one item of category ``label`` on either side.

    The labelled items are a semi-join key set, matched against the exploded
    items of the distinct rule keys, then semi-joined back; no Python."""
    labelled = item_category.where(F.col(category) == label).select(F.col(item).cast("string").alias("_it"))
    keys = (rules.select("rule_key", F.explode(F.concat("antecedent", "consequent")).alias("_it"))
            .join(labelled, "_it", "left_semi").select("rule_key").distinct())
    return rules.join(keys, "rule_key", "left_semi")


def rule_categories(rules: DataFrame, item_category: DataFrame, default: str = S.UNKNOWN_CATEGORY,
                    item: str = "item", category: str = "category") -> DataFrame:
    """M8: add ``Antecedent_Category`` / ``Consequent_Category``: the category
    of each item, in item order, ``Unknown`` when the item has none.

    Worked out once per distinct rule, then joined back on ``rule_key``."""
    cmap = item_category.select(F.col(item).cast("string").alias("_it"), F.col(category).alias("_cat"))
    distinct = rules.select("rule_key", "antecedent", "consequent").dropDuplicates(["rule_key"])
    parts = []
    for side, name in (("antecedent", "Antecedent_Category"), ("consequent", "Consequent_Category")):
        ex = distinct.select("rule_key", F.posexplode(side).alias("_pos", "_it"))
        cats = (ex.join(cmap, "_it", "left")
                .groupBy("rule_key")
                .agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_cat", F.lit(default)).alias("c"))))
                     .alias("_s"))
                .select("rule_key", F.col("_s.c").alias(name)))
        parts.append(cats)
    return rules.join(parts[0], "rule_key", "left").join(parts[1], "rule_key", "left")


def rule_status(rules: DataFrame, order: str = "grid_ord") -> DataFrame:
    """W1: 'new' on the first appearance of a rule key in grid order, else
    'existing'.  The window is partitioned by rule key; a key appears at most
    once per grid cell, so a partition is at most the grid size."""
    w = Window.partitionBy("rule_key").orderBy(order)
    return rules.withColumn("status", F.when(F.row_number().over(w) == 1, F.lit("new"))
                            .otherwise(F.lit("existing")))


def dedup_rules(rules: DataFrame, order: str | None = None) -> DataFrame:
    """One row per rule key.  With ``order`` the row with the smallest
    order value is kept; otherwise the highest support (ties: confidence),
    which within one fit are identical rows anyway."""
    cols = [c for c in rules.columns if c != "rule_key"]
    if order:
        pick = F.min_by(F.struct(*cols), F.col(order))
    else:
        pick = F.max_by(F.struct(*cols), F.struct(F.col("support"), F.col("confidence")))
    return rules.groupBy("rule_key").agg(pick.alias("_r")).select("rule_key", "_r.*")


def rule_status_summary(rules: DataFrame) -> DataFrame:
    """Unique rules and the number of 'new' / 'existing' rows."""
    return rules.agg(F.countDistinct("rule_key").alias("unique_rules"),
                     F.sum(F.when(F.col("status") == "new", 1).otherwise(0)).cast("long").alias("n_new"),
                     F.sum(F.when(F.col("status") == "existing", 1).otherwise(0)).cast("long").alias("n_existing"))
