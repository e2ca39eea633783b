"""The shop's inputs, derived from the TPC-H-style tables.

| ours          | from                                           |
| ------------- | ---------------------------------------------- |
| kode_nota     | l_orderkey                                     |
| tanggal       | o_orderdate                                    |
| id_barang     | l_partkey / p_partkey                          |
| deskripsi_brg | p_name                                         |
| jenis_barang  | p_type                                         |
| jml           | l_quantity                                     |
| platform      | c_mktsegment                                   |
| source        | o_orderpriority (the "file" a line came from)  |
| deadstock     | parts with no sale in the last year            |
| purchases     | every part                                     |

Only the columns a caller asks for are read; the customer table is joined only
when the platform is wanted, so Parquet column pruning stays effective.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_lines(spark: SparkSession, sf_dir: str, *, platform: bool = False,
                source: bool = False, names: bool = True, years: int | None = None) -> DataFrame:
    """Cleaned ledger: kode_nota, tanggal, id_barang, [deskripsi_brg,
    jenis_barang], jml, [platform], [source].

    lineitem x orders is the big equi-join (shuffle on the order key; AQE
    turns it into a broadcast only when the runtime size says so).  part is
    a dimension joined on its key; it is not hinted, because at 100 TB the
    part table itself is large — Spark's size check decides.

    ``years`` keeps the trailing window (C7) of the ledger.  The window is
    applied to *orders* before the big join: the reference date is the
    latest date of an order that has lines (a semi join on the line keys,
    one column), so the result equals windowing the joined ledger, but the
    join only meets the window's orders — and at scale Spark's runtime bloom
    filter drops the other lineitem rows before their shuffle.
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias(S.NOTA), F.col("l_partkey").alias(S.ITEM_ID),
        F.col("l_quantity").alias(S.QTY))
    ocols = [F.col("o_orderkey").alias(S.NOTA), F.col("o_orderdate").alias(S.DATE)]
    if platform:
        ocols.append(F.col("o_custkey"))
    if source:
        ocols.append(F.col("o_orderpriority").alias(S.SOURCE))
    orders = table(spark, sf_dir, "orders").select(*ocols)
    if years is not None:
        # distinct line keys: map-side partial aggregation collapses a
        # receipt's lines before the shuffle (a hot receipt ships one row per
        # task), and its partitioning is the one the semi join needs
        with_lines = orders.select(S.NOTA, S.DATE).join(li.select(S.NOTA).distinct(), S.NOTA, "left_semi")
        ref = with_lines.agg(F.max(S.DATE).alias("_ref"))
        orders = (orders.crossJoin(F.broadcast(ref))
                  .where(F.col(S.DATE) >= F.col("_ref") - F.expr(f"make_ym_interval({int(years)}, 0)"))
                  .drop("_ref"))
    df = li.join(orders, S.NOTA)
    if names:
        part = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias(S.ITEM_ID), F.col("p_name").alias(S.NAME),
            F.col("p_type").alias(S.GROUP))
        df = df.join(part, S.ITEM_ID)
    if platform:
        cust = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias(S.PLATFORM))
        df = df.join(cust, "o_custkey").drop("o_custkey")
    return df


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger in the shop's export layout (raw column names, date and
    quantity as text) — input of the cleaning operators.

    Export files are not clean, so fixed rows of the whole ledger are not,
    chosen by remainders of receipt and part: impossible and missing dates,
    dates written month first, missing and padded names, and quantities that
    are missing, carry a suffix or are text."""
    df = sales_lines(spark, sf_dir, source=True)
    nota, line = F.col(S.NOTA), F.col(S.NOTA) + F.col(S.ITEM_ID)
    return df.select(
        nota.cast("string").alias(S.RAW_NOTA),
        F.when(nota % 97 == 0, "31/31/2020").when(nota % 89 == 0, F.lit(None))
        .when(nota % 83 == 0, F.date_format(S.DATE, "MM/dd/yyyy"))
        .otherwise(F.date_format(S.DATE, "yyyy-MM-dd")).alias(S.RAW_DATE),
        F.when(line % 79 == 0, F.lit(None))
        .when(F.col(S.ITEM_ID) % 7 == 0, F.concat(F.lit("  "), F.col(S.NAME), F.lit(" ")))
        .otherwise(F.col(S.NAME)).alias(S.RAW_NAME),
        F.col(S.GROUP).alias(S.RAW_GROUP),
        F.when(line % 73 == 0, "3d").when(line % 71 == 0, F.lit(None)).when(line % 67 == 0, "-4,5 pcs")
        .otherwise(F.col(S.QTY).cast("string")).alias(S.RAW_QTY),
        F.col(S.SOURCE),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product dimension: id_barang, deskripsi_brg, jenis_barang."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(S.ITEM_ID), F.col("p_name").alias(S.NAME),
        F.col("p_type").alias(S.GROUP))


def deadstock_report(spark: SparkSession, sf_dir: str, years: int = 1, window: DataFrame | None = None) -> DataFrame:
    """The dead-stock report: one row per part, DS = '100' when the part has
    no sale in the last ``years`` before the latest order date.

    ``window``: lines (date, id_barang) with those of these years, where the
    caller has them (``sales_lines(years=...)``: the latest order may have no
    line, so its window begins no later); the ledger is not read again then.

    Columns: id_barang, `Deskripsi Brg`, `Jenis Barang`, DS.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    latest = orders.agg(F.max("o_orderdate").alias("_ref"))
    since = F.expr(f"_ref - make_ym_interval({years}, 0)")
    if window is None:
        recent = (orders.crossJoin(F.broadcast(latest)).where(F.col("o_orderdate") >= since)
                  .select(F.col("o_orderkey").alias("l_orderkey")))
        lines = (table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
                 .join(recent, "l_orderkey", "left_semi").select(F.col("l_partkey").alias(S.ITEM_ID)))
    else:
        lines = window.crossJoin(F.broadcast(latest)).where(F.col(S.DATE) >= since).select(S.ITEM_ID)
    sold = lines.distinct().withColumn("_sold", F.lit(True))
    part = products(spark, sf_dir)
    return (part.join(sold, S.ITEM_ID, "left")
            .select(S.ITEM_ID, F.col(S.NAME).alias(S.RAW_NAME),
                    F.col(S.GROUP).alias(S.RAW_GROUP),
                    F.when(F.col("_sold"), F.lit("0")).otherwise(F.lit(S.DEADSTOCK_FLAG)).alias("DS")))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase report: every part (`Deskripsi Brg`)."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias(S.RAW_NAME))


def text_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The second similarity workload: benchmark items (A) x documents (B),
    both as (id, text)."""
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return a, b
