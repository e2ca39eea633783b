"""Cleaning composites, RFM segmentation and product classification
(C2-C7, C10, A1, A2, A17, G8-G11, J13, J14, U3).

All per-product metrics are one ``groupBy`` with partial aggregation: a
product that sits on a third of all lines still ships one partial row per
map task.  Scalars (the latest date, ``n``) reach the rows through a one-row
broadcast cross join — never through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..functions.columns import row_hash
from ..functions.ordered import global_rank
from ..session import materialise, spread
from .joins import merge_ids


# ---------------------------------------------------------------- cleaning

def _date(raw: DataFrame) -> F.Column:
    return C.coerce_timestamp(S.RAW_DATE, raw.schema[S.RAW_DATE].dataType)


def clean_app(raw: DataFrame) -> DataFrame:
    """App cleaning (C3, C2, C4, C10): date coerced (unparsable dropped), rows
    with a null in the other required columns dropped, quantity coerced to
    int (unparsable dropped, truncation toward zero), names trimmed."""
    df = raw.withColumn(S.RAW_DATE, _date(raw)).where(F.col(S.RAW_DATE).isNotNull())
    df = df.na.drop("any", subset=[S.RAW_NOTA, S.RAW_NAME, S.RAW_GROUP, S.RAW_QTY])
    df = df.withColumn(S.RAW_QTY, C.coerce_qty_int(S.RAW_QTY)).where(F.col(S.RAW_QTY).isNotNull())
    return df.select(
        F.col(S.RAW_NOTA).cast("string").alias(S.NOTA), F.col(S.RAW_DATE).alias(S.DATE),
        F.trim(F.col(S.RAW_NAME).cast("string")).alias(S.NAME),
        F.trim(F.col(S.RAW_GROUP).cast("string")).alias(S.GROUP),
        F.col(S.RAW_QTY).alias(S.QTY),
        *[c for c in raw.columns if c not in S.RAW_COLUMNS])


def clean_notebook(raw: DataFrame) -> DataFrame:
    """Notebook cleaning (C5): dates parsed (an unparsable one is null, the row
    stays), quantity cleaned as text and kept as a double; names as they are."""
    return raw.select(
        F.col(S.RAW_NOTA).cast("string").alias(S.NOTA), _date(raw).alias(S.DATE),
        F.col(S.RAW_NAME).alias(S.NAME), F.col(S.RAW_GROUP).alias(S.GROUP),
        C.clean_qty_text(S.RAW_QTY).alias(S.QTY),
        *[c for c in raw.columns if c not in S.RAW_COLUMNS])


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Rows dropped by each app cleaning step, in one pass.

    Steps in order: invalid date; null in another required column; non-
    numeric quantity.  A row is charged to the first step that drops it.
    (The original's second counter had its sign inverted; this reports the
    true, positive number.)"""
    return raw.select(_dropping_step(raw).alias("_s")).agg(*_report_columns("_s"))


def _dropping_step(raw: DataFrame) -> F.Column:
    """Number of the app cleaning step that drops a row, 0 for a kept one."""
    bad_date = _date(raw).isNull()
    nulls = F.col(S.RAW_NOTA).isNull() | F.col(S.RAW_NAME).isNull() | F.col(S.RAW_GROUP).isNull() \
        | F.col(S.RAW_QTY).isNull()
    bad_qty = C.coerce_qty_int(S.RAW_QTY).isNull()
    return F.when(bad_date, 1).when(nulls, 2).when(bad_qty, 3).otherwise(0)


def _report_columns(step: str) -> list:
    def rows(n: int) -> F.Column:
        return F.count(F.when(F.col(step) == n, 1))
    return [F.count(F.lit(1)).alias("initial_rows"), rows(1).alias("dropped_dates"), rows(2).alias("dropped_other"),
            rows(3).alias("dropped_numeric"), rows(0).alias("kept_rows")]


#: Folders of ``clean_app_to``: the kept rows, and those that a step dropped.
CLEANED, QUARANTINE = 0, "quarantine"
DROPPING_STEPS = {1: "date", 2: "missing value", 3: "quantity"}


class CleanedLedger:
    """What ``clean_app_to`` wrote: ``rows`` (as ``clean_app`` gives them),
    ``quarantine`` (the raw columns of dropped rows with the step that dropped
    them) and ``report`` (as ``cleaning_report`` gives it, one row)."""

    def __init__(self, written: DataFrame, raw_columns: Sequence[str], counts: dict, fingerprint: int):
        extra = [c for c in raw_columns if c not in S.RAW_COLUMNS]
        kept = [S.NOTA, S.DATE, S.NAME, S.GROUP, S.QTY]
        step = F.col("_step")
        self.rows = written.where(step == CLEANED).select(*kept, *extra)
        label = F.element_at(F.create_map(*[F.lit(x) for kv in DROPPING_STEPS.items() for x in kv]), step)
        self.quarantine = written.where(step != CLEANED).select(
            label.alias("step"), *[F.col(f"_raw{i}").alias(c) for i, c in enumerate(S.RAW_COLUMNS)], *extra)
        names = ["initial_rows", "dropped_dates", "dropped_other", "dropped_numeric", "kept_rows"]
        self.counts = {c: int(counts[c]) for c in names}
        self.report = written.sparkSession.createDataFrame(
            [tuple(self.counts.values())], ", ".join(f"{c} long" for c in names))
        self.fingerprint, self.schema = fingerprint, written.schema


def clean_app_to(raw: DataFrame, path: str) -> CleanedLedger:
    """C3, C2, C4, C10 and C6 in one read of the raw ledger: the cleaned rows
    and the quarantine are written under ``path`` (one folder per step), and
    the report is observed while they are written; so is a fingerprint of the
    raw rows (``fingerprint``), whatever their order."""
    step = _dropping_step(raw)
    cleaned = raw.select(
        F.col(S.RAW_NOTA).cast("string").alias(S.NOTA), _date(raw).alias(S.DATE),
        F.trim(F.col(S.RAW_NAME).cast("string")).alias(S.NAME),
        F.trim(F.col(S.RAW_GROUP).cast("string")).alias(S.GROUP), C.coerce_qty_int(S.RAW_QTY).alias(S.QTY),
        *[F.when(step != CLEANED, F.col(f"`{c}`").cast("string")).alias(f"_raw{i}") for i, c in enumerate(S.RAW_COLUMNS)],
        *[c for c in raw.columns if c not in S.RAW_COLUMNS],
        step.alias("_step"), row_hash(raw).alias("_hash"))
    seen = Observation("cleaning")
    cleaned = cleaned.observe(seen, *_report_columns("_step"), F.sum("_hash").alias("fingerprint")).drop("_hash")
    cleaned.write.mode("overwrite").partitionBy("_step").parquet(path)
    counts = seen.get
    written = raw.sparkSession.read.schema(cleaned.schema).parquet(path)
    return CleanedLedger(written, raw.columns, counts, int(counts["fingerprint"] or 0))


def reference_date(lines: DataFrame, date: str = S.DATE) -> DataFrame:
    """One-row frame with the latest date (``ref_date``)."""
    return lines.agg(F.max(date).alias("ref_date"))


def trailing_window(lines: DataFrame, years: int = 1, date: str = S.DATE) -> DataFrame:
    """Rows with ``date >= max(date) - years`` (inclusive; a 29 February
    maximum steps back to 28 February)."""
    ref = reference_date(lines, date)
    return (lines.crossJoin(F.broadcast(ref))
            .where(F.col(date) >= F.col("ref_date") - F.expr(f"make_ym_interval({int(years)}, 0)"))
            .drop("ref_date"))


# ------------------------------------------------------------ RFM metrics

def _days_between(ref, last) -> F.Column:
    """Whole days from ``last`` to ``ref`` (floor of the elapsed time)."""
    return F.floor((F.unix_micros(F.col(ref).cast("timestamp")) - F.unix_micros(F.col(last).cast("timestamp")))
                   / F.lit(86_400_000_000)).cast("int")


def rfm_metrics(lines: DataFrame, key: str = S.NAME, with_group: bool = False) -> DataFrame:
    """A1: per product — recency (whole days from its last sale to the global
    last sale), frequency (distinct receipts), monetary (sum of quantity; 0
    when every quantity is null)."""
    aggs = [F.max(S.DATE).alias("_last"), F.countDistinct(S.NOTA).alias("frequency"),
            F.coalesce(F.sum(S.QTY), F.lit(0)).alias("monetary")]
    if with_group:
        aggs.append(_first_group())
    # One pass over the ledger: lines without a key form a group of their
    # own, so the latest date overall is the latest of the group maxima (the
    # same aggregate feeds both branches; its exchange is reused).
    per_all = lines.groupBy(key).agg(*aggs)
    ref = per_all.agg(F.max("_last").alias("ref_date"))
    per = per_all.where(F.col(key).isNotNull())
    return (per.crossJoin(F.broadcast(ref)).withColumn("recency", _days_between("ref_date", "_last"))
            .drop("_last", "ref_date"))


class SplitReceiptError(ValueError):
    """Raised with the number of receipts that have lines of several dates."""


def check_receipt_dates(lines: DataFrame) -> DataFrame:
    """A receipt has one date; fail if one has several (roll-ups add up
    receipts over dates).  One aggregate with partial aggregation."""
    split = (lines.where(F.col(S.NOTA).isNotNull()).groupBy(S.NOTA)
             .agg((F.min(S.DATE) < F.max(S.DATE)).alias("_two")).where("_two").count())
    if split:
        raise SplitReceiptError(f"{split} receipts have lines of several dates")
    return lines


def daily_rollup(lines: DataFrame, key: str = S.NAME) -> DataFrame:
    """A mergeable roll-up of the ledger: per product (null for lines without
    one) and date the distinct receipts and the quantity.

    As a receipt has one date (``check_receipt_dates``), its receipts add up
    over dates, so metrics of any window, and of any new days that are merged
    in (``merge_rollups``), come from the roll-up and not from the ledger.
    The lines are dealt out by product and date once (``spread``)."""
    return spread(lines.select(key, S.DATE, S.NOTA, S.QTY), key, S.DATE).groupBy(key, S.DATE).agg(F.countDistinct(S.NOTA).alias("receipts"),
                                          F.coalesce(F.sum(S.QTY), F.lit(0)).alias("quantity"))


def merge_rollups(*parts: DataFrame, key: str = S.NAME) -> DataFrame:
    """One roll-up of the ledgers (of distinct receipts) behind ``parts``."""
    return (reduce(DataFrame.unionByName, parts).groupBy(key, S.DATE)
            .agg(F.sum("receipts").alias("receipts"), F.sum("quantity").alias("quantity")))


def window_metrics(rollup: DataFrame, years: Sequence[int] = S.TREND_YEARS, key: str = S.NAME) -> DataFrame:
    """A1/A2/C7 for several trailing windows from one roll-up: years, product,
    recency, frequency, monetary.

    A window of ``y`` years has the dates from the latest one minus ``y`` years
    on, as in ``trailing_window``; a row of the roll-up counts in each window
    that holds its date (at most ``len(years)`` rows), so the ledger is read
    once for all."""
    ref = rollup.agg(F.max(S.DATE).alias("ref_date"))
    within = [F.when(F.col(S.DATE) >= F.col("ref_date") - F.expr(f"make_ym_interval({int(y)}, 0)"), F.lit(int(y)))
              for y in years]
    held = (rollup.where(F.col(key).isNotNull()).crossJoin(F.broadcast(ref))
            .withColumn("years", F.explode(F.array_compact(F.array(*within)))))
    return (held.groupBy("years", key)
            .agg(F.max(S.DATE).alias("_last"), F.max("ref_date").alias("_ref"),
                 F.sum("receipts").alias("frequency"), F.sum("quantity").alias("monetary"))
            .withColumn("recency", _days_between("_ref", "_last")).drop("_last", "_ref"))


def _first_group(order: str = S.DATE) -> F.Column:
    """'first non-null group seen': the group of the earliest line (ties:
    the smallest group text) — explicit, since Spark rows have no order."""
    return F.min_by(F.col(S.GROUP), F.struct(F.col(order), F.col(S.GROUP))).alias(S.GROUP)


def fm_metrics(lines: DataFrame, key: str = S.NAME,
               keywords=S.TYPE_KEYWORDS) -> DataFrame:
    """A2: frequency and monetary per product, plus its type (G1 of the
    group of its first line)."""
    per = (lines.where(F.col(key).isNotNull()).groupBy(key)
           .agg(_first_group(), F.countDistinct(S.NOTA).alias("frequency"),
                F.coalesce(F.sum(S.QTY), F.lit(0)).alias("monetary")))
    return per.withColumn("product_type", C.product_type(S.GROUP, keywords)).drop(S.GROUP)


# ------------------------------------------------------------ segmentation

def segment(lines: DataFrame, variant: str = "V1", key: str = S.NAME,
            keywords=S.TYPE_KEYWORDS, f_cuts: Sequence[float] = S.FLAT_F_THRESHOLDS,
            m_cuts: Sequence[float] = S.FLAT_M_THRESHOLDS,
            f_table=S.F_THRESHOLDS, m_table=S.M_THRESHOLDS) -> DataFrame:
    """The four segmentations.

    | variant | scores                 | ladder | notes                        |
    | V1      | R, F, M flat           | A      |                              |
    | V2      | F, M flat              | B      | recency computed, unused     |
    | V3      | F, M by product type   | B      | no recency                   |
    | V4      | R = 5, F, M by type    | A      | app; caller windows the data |
    """
    if variant in ("V1", "V2"):
        m = rfm_metrics(lines, key)
        m = m.withColumn("r_score", C.score_recency("recency")) \
             .withColumn("f_score", C.score_cuts("frequency", f_cuts)) \
             .withColumn("m_score", C.score_cuts("monetary", m_cuts))
        ladder = C.category_rfm("r_score", "f_score", "m_score") if variant == "V1" \
            else C.category_fm("f_score", "m_score")
        return m.withColumn("category", ladder)
    if variant == "V3":
        m = fm_metrics(lines, key, keywords)
        m = m.withColumn("f_score", C.score_by_type("frequency", "product_type", f_table)) \
             .withColumn("m_score", C.score_by_type("monetary", "product_type", m_table))
        return m.withColumn("category", C.category_fm("f_score", "m_score"))
    if variant == "V4":
        m = rfm_metrics(lines, key, with_group=True)
        m = m.withColumn("product_type", C.product_type(S.GROUP, keywords)).drop(S.GROUP)
        m = m.withColumn("r_score", F.lit(5)) \
             .withColumn("f_score", C.score_by_type("frequency", "product_type", f_table)) \
             .withColumn("m_score", C.score_by_type("monetary", "product_type", m_table))
        return m.withColumn("category", C.category_rfm("r_score", "f_score", "m_score"))
    raise ValueError(f"unknown variant {variant}")


def segment_platforms(lines: DataFrame, variant: str = "V1", key: str = S.NAME,
                      **kw) -> DataFrame:
    """V1 per platform (the per-platform copies): the platform is part of the
    product key and the reference date is the platform's own latest sale."""
    m_all = (lines.groupBy(S.PLATFORM, key)
             .agg(F.max(S.DATE).alias("_last"), F.countDistinct(S.NOTA).alias("frequency"),
                  F.coalesce(F.sum(S.QTY), F.lit(0)).alias("monetary")))
    # a platform's latest sale = the latest of its groups (null key included)
    ref = m_all.groupBy(S.PLATFORM).agg(F.max("_last").alias("ref_date"))
    m = m_all.where(F.col(key).isNotNull()).join(ref, S.PLATFORM) \
        .withColumn("recency", _days_between("ref_date", "_last")).drop("_last", "ref_date")
    m = m.withColumn("r_score", C.score_recency("recency")) \
         .withColumn("f_score", C.score_cuts("frequency", kw.get("f_cuts", S.FLAT_F_THRESHOLDS))) \
         .withColumn("m_score", C.score_cuts("monetary", kw.get("m_cuts", S.FLAT_M_THRESHOLDS)))
    return m.withColumn("category", C.category_rfm("r_score", "f_score", "m_score"))


def category_dimension(seg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct categories with ids 1..k (by label: at most nine rows,
    so numbering them is a bounded, broadcast-sized step) and the segment
    rows re-keyed to ``id_category``."""
    from pyspark.sql import Window
    cats = seg.select("category").distinct()
    dim = cats.withColumn("id_category", F.row_number().over(Window.orderBy("category")).cast("long"))
    return dim, seg.join(F.broadcast(dim), "category").drop("category")


# ------------------------------------------------------- classification

def classify_products(lines: DataFrame, dead_names: DataFrame, purchased: DataFrame,
                      item: str = S.NAME) -> DataFrame:
    """One row per (class, product) for the classes Sold Together,
    Sold Alone, Not Sold, Unclassified and All Products.

    Sold Alone = in exactly one receipt and never sold together; Not Sold =
    dead-stock names; Unclassified = (sold or purchased) minus the three;
    All Products = (sold or purchased) minus Unclassified.

    The ledger is reduced once to distinct (receipt, product) pairs; each
    pair learns its receipt's width (an aggregate on the receipt joined
    back, so a hot receipt is split by AQE's skew handling rather than held
    by one window task).  One aggregation per product then gives every flag
    (sold, together, receipts), the purchase and dead-stock lists join in
    as flag rows of the same aggregation, and the classes are one explode of
    the per-product flags — the set algebra runs on one row per product,
    never again on the ledger."""
    pairs = lines.where(F.col(item).isNotNull()).select(S.NOTA, F.col(item).alias("product")).distinct()
    width = pairs.groupBy(S.NOTA).agg(F.count(F.lit(1)).alias("_w"))
    sold = (pairs.join(width, S.NOTA)
            .groupBy("product")
            .agg(F.count(F.lit(1)).alias("_n"), F.max((F.col("_w") > 1).cast("int")).alias("_tog"))
            .select("product", F.lit(1).alias("_sold"), "_tog",
                    (F.col("_n") == 1).cast("int").alias("_once"),
                    F.lit(0).alias("_bought"), F.lit(0).alias("_dead")))
    bought = purchased.select(F.col(S.NAME).alias("product"), F.lit(0).alias("_sold"), F.lit(0).alias("_tog"),
                              F.lit(0).alias("_once"), F.lit(1).alias("_bought"), F.lit(0).alias("_dead"))
    dead = dead_names.select(F.col(S.NAME).alias("product"), F.lit(0).alias("_sold"), F.lit(0).alias("_tog"),
                             F.lit(0).alias("_once"), F.lit(0).alias("_bought"), F.lit(1).alias("_dead"))
    flags = (sold.unionByName(bought).unionByName(dead).where(F.col("product").isNotNull())
             .groupBy("product")
             .agg(*[F.max(c).alias(c) for c in ["_sold", "_tog", "_once", "_bought", "_dead"]]))
    together = F.col("_tog") == 1
    alone = (F.col("_once") == 1) & (F.col("_tog") == 0)
    not_sold = F.col("_dead") == 1
    universe = (F.col("_sold") == 1) | (F.col("_bought") == 1)
    classified = together | alone | not_sold
    classes = [("All Products", universe & classified), ("Sold Together", together),
               ("Sold Alone", alone), ("Not Sold", not_sold), ("Unclassified", universe & ~classified)]
    labels = F.array(*[F.when(cond, F.lit(label)) for label, cond in classes])
    return (flags.select(F.explode(labels).alias("class"), "product")
            .where(F.col("class").isNotNull()))


def class_counts(classes: DataFrame) -> DataFrame:
    """G10 counts per class."""
    return classes.groupBy("class").agg(F.count(F.lit(1)).alias("n_products"))


# ------------------------------------------------- product dimension (app)

def product_dimension(lines: DataFrame, dead_report: DataFrame | None = None,
                      order: str = S.DATE, known: DataFrame | None = None) -> DataFrame:
    """One row per trimmed name with the group of its first line,
    then dead-stock names absent from the sales appended; ids follow that
    order (sold names by first sale, then dead names), numbered with a
    distributed global rank.  Columns: id_barang, deskripsi_brg,
    jenis_barang, is_deadstock.

    With ``known`` (deskripsi_brg, id_barang of earlier loads, see
    ``joins.merge_ids``) known names keep their id and new ones continue after
    the greatest, so what was stored under an id stays right."""
    dims, place = _product_names(lines, dead_report, order)
    if known is not None:
        dims = materialise(dims, "product-names")
        ids = merge_ids(known, dims, S.NAME, place)
        return dims.join(ids, S.NAME).select(S.ITEM_ID, S.NAME, S.GROUP, "is_deadstock")
    return global_rank(dims, place, rank_col=S.ITEM_ID).select(S.ITEM_ID, S.NAME, S.GROUP, "is_deadstock")


def _product_names(lines: DataFrame, dead_report: DataFrame | None, order: str = S.DATE):
    """(one row per product name, the order of their ids)."""
    sold = (lines.select(F.trim(F.col(S.NAME)).alias(S.NAME), S.GROUP, order)
            .where(F.col(S.NAME).isNotNull())
            .groupBy(S.NAME)
            .agg(F.min_by(F.struct(F.trim(F.col(S.GROUP)).alias("g"), F.col(order).alias("o")),
                          F.struct(F.col(order), F.col(S.GROUP))).alias("_f"))
            .select(F.lit(0).alias("_part"), F.col("_f.o").cast("string").alias("_o"), S.NAME,
                    F.col("_f.g").alias(S.GROUP), F.lit(False).alias("is_deadstock")))
    dims = sold
    if dead_report is not None:
        dead = unsold_deadstock(dead_report, sold)
        dims = sold.unionByName(dead.select(F.lit(1).alias("_part"), F.lit("").alias("_o"), S.NAME,
                                            S.GROUP, F.lit(True).alias("is_deadstock")))
    return dims, [F.col("_part"), F.col("_o"), F.col(S.NAME)]


def product_ids(lines: DataFrame, dead_report: DataFrame | None = None, order: str = S.DATE,
                known: DataFrame | None = None) -> DataFrame:
    """The registry of product names (deskripsi_brg, id_barang) after this
    load, see ``joins.merge_ids``."""
    dims, place = _product_names(lines, dead_report, order)
    return merge_ids(known, dims, S.NAME, place)


def unsold_deadstock(dead_report: DataFrame, sold_names: DataFrame) -> DataFrame:
    """Dead-stock rows (DS = '100') whose trimmed name is not among the
    sold names; one row per name with its (trimmed) group, '' if absent."""
    grp = F.trim(F.col(f"`{S.RAW_GROUP}`").cast("string")) if S.RAW_GROUP in dead_report.columns \
        else F.lit("")
    dead = (dead_report.where(F.trim(F.col("DS").cast("string")) == S.DEADSTOCK_FLAG)
            .select(F.trim(F.col(f"`{S.RAW_NAME}`").cast("string")).alias(S.NAME),
                    F.coalesce(grp, F.lit("")).alias(S.GROUP)))
    dead = dead.groupBy(S.NAME).agg(F.min(S.GROUP).alias(S.GROUP))
    return dead.join(sold_names.select(S.NAME), S.NAME, "left_anti")


def key_sales(lines: DataFrame, product: DataFrame) -> DataFrame:
    """Cleaned rows -> (kode_nota, tanggal as date, id_barang, jml as
    int); names without an id are skipped (inner join on trimmed name)."""
    dim = product.select(S.ITEM_ID, F.col(S.NAME).alias("_nm"))
    src = lines.drop(S.ITEM_ID) if S.ITEM_ID in lines.columns else lines
    return (src.withColumn("_nm", F.trim(F.col(S.NAME))).join(dim, "_nm")
            .select(F.col(S.NOTA).cast("string").alias(S.NOTA), F.to_date(S.DATE).alias(S.DATE),
                    S.ITEM_ID, F.col(S.QTY).cast("int").alias(S.QTY)))
