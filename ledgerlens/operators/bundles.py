"""Bundles (M4, M5, M9, M10, M12-M16, J1-J3, J7-J10, J12, A11-A13).

A bundle is a rule stored as a header (id_bundling, support, lift,
confidence) plus one item row per (id_bundling, id_barang, role).  Every
"first match" of the original loops is an explicit order here, resolved by
an aggregate per key (min / min_by), never by a row loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import clean_product_name, normalise_name
from ..functions.ordered import global_rank
from . import baskets as B
from . import rules as R
from ..session import materialise
from .similarity import TextPairs

ROLE_A, ROLE_C = "antecedent", "consequent"


# ------------------------------------------------------------- mining flows

def bundle_all(lines: DataFrame, min_support: float, min_conf: float,
               item: str = S.NAME, num_partitions: int | None = None) -> DataFrame:
    """M4 (rules part): C11 -> A3 -> M1 -> W7."""
    bk = B.multi_item_sets(lines, item=item)
    return R.dedup_rules(R.mine_rules(bk, min_support, min_conf, num_partitions=num_partitions))


def name_category(seg: DataFrame, product: DataFrame, key: str = S.ITEM_ID,
                  normalise: bool = False) -> DataFrame:
    """Category per product *name* from a per-id segmentation; when
    several ids share a name (with ``normalise`` after lower-casing and
    trimming) the last one (largest id) wins, as a dictionary built in id
    order would.  Columns (item, category)."""
    named = product.select(key, (normalise_name(S.NAME) if normalise else F.col(S.NAME)).alias(S.NAME))
    return (seg.select(key, "category").join(named, key)
            .groupBy(S.NAME).agg(F.max_by("category", key).alias("category"))
            .select(F.col(S.NAME).alias("item"), "category"))


def deadstock_baskets(lines: DataFrame, item_category: DataFrame, item: str = S.NAME,
                      label: str = S.CAT_DEADSTOCK, line_key: str | None = None,
                      line_category: DataFrame | None = None) -> DataFrame:
    """M5: J2 (left join the category of each line), then in one aggregate per
    receipt C11 (more than one item row), J5 (any dead-stock line) and A3 over
    ``item``: the lines are read and shuffled by receipt once.

    ``item_category`` holds (item, category), one row per item.  When the
    line's category comes from another key (the app flags a line by its
    product id but mines names), pass ``line_key`` and ``line_category``
    (keyed by ``item`` column holding that key)."""
    key = line_key or item
    src = line_category if line_category is not None else item_category
    cats = src.select(F.col("item").alias("_k"), F.col("category"))
    joined = lines.join(cats, lines[key] == cats["_k"], "left").drop("_k")
    return B.flagged_item_sets(joined, F.col("category") == label, item=item)


def bundle_deadstock(lines: DataFrame, item_category: DataFrame, supports: Sequence[float],
                     confs: Sequence[float], item: str = S.NAME, normalise: bool = False,
                     num_partitions: int | None = None, line_key: str | None = None,
                     line_category: DataFrame | None = None) -> DataFrame:
    """Dead-stock baskets mined over a grid, rules that touch dead
    stock, their category arrays and new/existing status.

    ``normalise`` (M10) lower-cases and trims the lines' names and drops null
    names/receipts first; ``item_category`` then holds normalised names (see
    ``name_category``).  No dead-stock basket -> an empty, typed
    result (never an exception)."""
    if normalise:
        lines = (lines.withColumn(item, normalise_name(item))
                 .na.drop(subset=[item, S.NOTA]))
        item_category = item_category.na.drop(subset=["item", "category"])
    # one row per product, read by the basket filter, the rule filter and both
    # category arrays: materialised once
    item_category = materialise(item_category, "item_category")
    bk = deadstock_baskets(lines, item_category, item, line_key=line_key, line_category=line_category)
    rules = R.mine_grid(bk, supports, confs, num_partitions=num_partitions)
    # the kept rules feed both category arrays and the status window
    rules = materialise(R.rules_touching(rules, item_category), "touching_rules")
    rules = R.rule_categories(rules, item_category)
    return R.rule_status(rules).withColumn("validity", F.lit(None).cast("int"))


# ------------------------------------------------------ header / item tables

def name_to_id(product: DataFrame) -> DataFrame:
    """Name -> first id (the smallest), one row per name."""
    return product.groupBy(S.NAME).agg(F.min(S.ITEM_ID).alias(S.ITEM_ID))


def normalise_bundles(rules: DataFrame, product: DataFrame,
                      order=None) -> tuple[DataFrame, DataFrame]:
    """Rules -> (header, items).

    Header ids 1..N follow ``order`` (default support desc, then rule key)
    and come from a distributed global rank.  Items: each name mapped to its
    first id; unmatched names dropped; duplicate (bundle, id, role) rows
    removed."""
    order = order or [F.col("support").desc(), F.col("rule_key")]
    ranked = global_rank(rules.select("rule_key", "antecedent", "consequent", "support", "lift", "confidence"),
                         order, rank_col="id_bundling")
    header = ranked.select("id_bundling", "support", "lift", "confidence", "rule_key")
    ids = name_to_id(product)
    items = (ranked.select("id_bundling", F.explode(F.array(
                F.struct(F.lit(ROLE_A).alias("role"), F.col("antecedent").alias("names")),
                F.struct(F.lit(ROLE_C).alias("role"), F.col("consequent").alias("names")))).alias("_s"))
             .select("id_bundling", F.col("_s.role").alias("role"), F.explode("_s.names").alias(S.NAME))
             .join(ids, S.NAME).select("id_bundling", S.ITEM_ID, "role").dropDuplicates())
    return header, items


def first_partner(similarity: DataFrame | TextPairs, best_score: bool = False) -> DataFrame:
    """One dead-stock partner per sold item — the first inserted pair
    (smallest id_barang_2), or the best score with ``best_score``.

    Of pairs of texts each side has its smallest id, and the items of one text
    have one partner: the pairs of all items are never made."""
    if isinstance(similarity, TextPairs):
        texts = similarity.pairs.select(F.col("id_1").alias("id_barang_1"), F.col("id_2").alias("id_barang_2"), "score")
        partner = first_partner(texts, best_score).withColumnRenamed("id_barang_1", "id")
        return similarity.members("A", partner).withColumnRenamed("id", "id_barang_1")
    if best_score:
        pick = F.max_by(F.col("id_barang_2"), F.struct(F.col("score"), -F.col("id_barang_2")))
    else:
        pick = F.min(F.col("id_barang_2"))
    return similarity.groupBy("id_barang_1").agg(pick.alias("replacement"))


def replace_first(header: DataFrame, items: DataFrame, similarity: DataFrame | TextPairs,
                  best_score: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M13 (app): in every bundle replace only the **first** antecedent (by
    id_barang) that has a similar dead item; if none, the first such
    consequent.  Bundles with no replacement are dropped; metrics copied; the
    new bundles are numbered 1..N in the order of the old ids.

    Returns (new header, new items, changes) where changes has
    (id_bundling, role, old_id, new_id, new_id_bundling)."""
    partner = first_partner(similarity, best_score)
    matched = items.join(partner, items[S.ITEM_ID] == partner["id_barang_1"]).drop("id_barang_1")
    # choose the side first (antecedent beats consequent), then the smallest id
    side_rank = F.when(F.col("role") == ROLE_A, 0).otherwise(1)
    choice = (matched.groupBy("id_bundling")
              .agg(F.min_by(F.struct(F.col("role"), F.col(S.ITEM_ID).alias("old_id"),
                                     F.col("replacement").alias("new_id")),
                            F.struct(side_rank, F.col(S.ITEM_ID))).alias("_c"))
              .select("id_bundling", "_c.*"))
    # one row per bundle, used by header, items and log; the rank has written it
    choice = global_rank(choice, [F.col("id_bundling")], rank_col="new_id_bundling")
    new_header = (header.join(choice.select("id_bundling", "new_id_bundling"), "id_bundling")
                  .withColumn("id_bundling", F.col("new_id_bundling")).drop("new_id_bundling"))
    new_items = (items.join(choice.withColumnRenamed("role", "_r"), "id_bundling")
                 .select(F.col("new_id_bundling").alias("id_bundling"),
                         F.when((F.col("role") == F.col("_r")) & (F.col(S.ITEM_ID) == F.col("old_id")),
                                F.col("new_id")).otherwise(F.col(S.ITEM_ID)).alias(S.ITEM_ID),
                         "role")
                 .dropDuplicates())
    return new_header, new_items, choice


def change_log(header_items_old: DataFrame, header_items_new: DataFrame, changed: DataFrame,
               product: DataFrame) -> DataFrame:
    """Per replaced bundle (its old id) the old and new antecedent/
    consequent names, ', '-joined (sorted; a missing name shows as 'ID n')."""
    names = product.select(S.ITEM_ID, S.NAME)
    ids = changed.select("id_bundling", "new_id_bundling")

    def lists(items: DataFrame, tag: str) -> DataFrame:
        named = (items.join(names, S.ITEM_ID, "left")
                 .withColumn("_nm", F.coalesce(F.col(S.NAME), F.concat(F.lit("ID "), F.col(S.ITEM_ID).cast("string")))))
        return named.groupBy("id_bundling").agg(
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == ROLE_A, F.col("_nm")))), ", ")
            .alias(f"antecedent_{tag}"),
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == ROLE_C, F.col("_nm")))), ", ")
            .alias(f"consequent_{tag}"))

    old = header_items_old.join(ids.select("id_bundling"), "id_bundling", "left_semi")
    new = (header_items_new.withColumnRenamed("id_bundling", "new_id_bundling").join(ids, "new_id_bundling")
           .drop("new_id_bundling"))
    return lists(old, "old").join(lists(new, "new"), "id_bundling")


def replace_all_in_side(rules: DataFrame, pairs: DataFrame) -> DataFrame:
    """M14 (notebook): names cleaned (C9) before matching; every antecedent
    with a similar dead item is replaced; only if none matched, every such
    consequent.  ``replaced_item`` = the cleaned name of the last replaced
    item (by position in the sorted list).  Only rows with a replacement
    are kept.

    ``pairs`` has (sold, dead, score); a sold name's partner is the first
    pair: the smallest dead name."""
    p = (pairs.withColumn("_sold", clean_product_name("sold"))
         .withColumn("_dead", clean_product_name("dead"))
         .groupBy("_sold").agg(F.min("_dead").alias("_rep")))
    base = rules.select("rule_key", "antecedent", "consequent").dropDuplicates(["rule_key"])
    sides = []
    for side, tag in (("antecedent", 0), ("consequent", 1)):
        ex = base.select("rule_key", F.lit(tag).alias("_side"),
                         F.posexplode(side).alias("_pos", "_name"))
        sides.append(ex)
    ex = sides[0].unionByName(sides[1]).withColumn("_clean", clean_product_name("_name"))
    ex = materialise(ex.join(p, ex["_clean"] == p["_sold"], "left").drop("_sold"), "rule_items")
    # the side that gets replaced: antecedent if any antecedent matched
    side_pick = (ex.where(F.col("_rep").isNotNull()).groupBy("rule_key")
                 .agg(F.min("_side").alias("_rside"),
                      F.max_by(F.col("_clean"), F.struct(-F.col("_side"), F.col("_pos"))).alias("replaced_item")))
    ex = ex.join(side_pick, "rule_key")
    ex = ex.withColumn("_new", F.when((F.col("_side") == F.col("_rside")) & F.col("_rep").isNotNull(),
                                      F.col("_rep")).otherwise(F.col("_name")))
    rebuilt = ex.groupBy("rule_key", "replaced_item").agg(
        F.array_sort(F.collect_list(F.when(F.col("_side") == 0, F.struct("_pos", "_new")))).alias("_a"),
        F.array_sort(F.collect_list(F.when(F.col("_side") == 1, F.struct("_pos", "_new")))).alias("_c"))
    rebuilt = rebuilt.select("rule_key", "replaced_item", F.col("_a._new").alias("antecedent_replaced"),
                             F.col("_c._new").alias("consequent_replaced"))
    return rules.join(rebuilt, "rule_key")


# ------------------------------------------------------------ checks & joins

def orphan_bundles(header: DataFrame, items: DataFrame, product: DataFrame) -> DataFrame:
    """Per table the number of (antecedent row x consequent row) pairs
    of a bundle where either item is missing from the product table.

    Counted arithmetically per bundle — A*C - A_ok*C_ok — so no pair is
    ever materialised."""
    known = product.select(S.ITEM_ID).distinct().withColumn("_ok", F.lit(1))
    it = items.join(header.select("id_bundling"), "id_bundling", "left_semi").join(known, S.ITEM_ID, "left")
    per = it.groupBy("id_bundling").agg(
        F.sum(F.when(F.col("role") == ROLE_A, 1).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("role") == ROLE_C, 1).otherwise(0)).alias("c"),
        F.sum(F.when((F.col("role") == ROLE_A) & F.col("_ok").isNotNull(), 1).otherwise(0)).alias("a_ok"),
        F.sum(F.when((F.col("role") == ROLE_C) & F.col("_ok").isNotNull(), 1).otherwise(0)).alias("c_ok"))
    return per.agg(F.coalesce(F.sum(F.col("a") * F.col("c") - F.col("a_ok") * F.col("c_ok")), F.lit(0))
                   .cast("long").alias("orphans"))


def consistency(tables: dict[str, DataFrame], bundle_sets: dict[str, tuple[DataFrame, DataFrame]],
                product: DataFrame) -> DataFrame:
    """Supporting tables (product, rfm, category) non-empty, any bundle
    table non-empty, and zero orphans in every bundle set.  One row."""
    from ..sources.io import tables_status
    status = tables_status(tables)
    support_ok = status.where(F.col("table_name").isin("barang", "rfm", "category")).agg(
        F.min(F.col("has_rows").cast("int")).alias("_s"))
    bundles_ok = status.where(F.col("table_name").isin(*bundle_sets)).agg(
        F.max(F.col("has_rows").cast("int")).alias("_b"))
    orphan = None
    for name, (h, i) in bundle_sets.items():
        o = orphan_bundles(h, i, product).select(F.lit(name).alias("bundle_table"), "orphans")
        orphan = o if orphan is None else orphan.unionByName(o)
    orph_tot = orphan.agg(F.sum("orphans").alias("_o"))
    return (support_ok.crossJoin(bundles_ok).crossJoin(orph_tot)
            .select((F.col("_s") == 1).alias("has_supporting_data"),
                    (F.col("_b") == 1).alias("any_bundles"),
                    F.col("_o").cast("long").alias("orphans"),
                    ((F.col("_s") == 1) & (F.col("_b") == 1) & (F.col("_o") == 0)).alias("consistent")))


def bundle_detail(header: DataFrame, items: DataFrame, product: DataFrame,
                  item_category: DataFrame | None = None) -> DataFrame:
    """Bundle x item x product (inner), category per item (left)."""
    d = (header.select("id_bundling", "support", "lift", "confidence")
         .join(items, "id_bundling").join(product.select(S.ITEM_ID, S.NAME), S.ITEM_ID))
    if item_category is not None:
        d = d.join(item_category.select(F.col("item").alias(S.ITEM_ID), "category"), S.ITEM_ID, "left")
    return d


def bundle_report(detail: DataFrame, with_category: bool = True,
                  missing_category: str | None = None, keep_id: bool = False) -> DataFrame:
    """Per bundle the distinct antecedent names, consequent
    names (and the categories of both) as sorted ', ' lists, plus metrics.
    ``missing_category`` replaces a null category (A13)."""
    cat = F.col("category")
    if missing_category is not None:
        cat = F.coalesce(cat, F.lit(missing_category))
    aggs = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == ROLE_A, F.col(S.NAME)))), ", ")
            .alias("antecedents"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == ROLE_C, F.col(S.NAME)))), ", ")
            .alias("consequents")]
    if with_category:
        aggs += [F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == role, cat))), ", ").alias(name)
                 for role, name in ((ROLE_A, "antecedent_categories"), (ROLE_C, "consequent_categories"))]
    out = detail.groupBy("id_bundling", "support", "lift", "confidence").agg(*aggs)
    return out if keep_id else out.drop("id_bundling")
