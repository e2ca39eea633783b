"""Incremental loading of ledger exports (S1 + C* + S7 on a file stream).

The original analysis has no streaming operator; its inputs are exports that
arrive file by file.  The cleaning operators are row-wise (no state), so the
same functions run unchanged on a streaming DataFrame: each micro-batch of
new files is cleaned and appended to the platform-partitioned sales table.
The stream's checkpoint location makes every file land exactly once, also
after a restart.  Analyses (segmentation, mining) stay batch jobs over the
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators.segment import clean_app

RAW_SCHEMA = T.StructType([
    T.StructField(S.RAW_NOTA, T.StringType()),
    T.StructField(S.RAW_DATE, T.StringType()),
    T.StructField(S.RAW_NAME, T.StringType()),
    T.StructField(S.RAW_GROUP, T.StringType()),
    T.StructField(S.RAW_QTY, T.StringType()),
])


def read_exports(spark: SparkSession, folder: str, fmt: str = "csv",
                 schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """A stream of raw export rows from files dropped into ``folder``; the
    source file name is kept (S9 checks it against the platform)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(folder).withColumn("file_name", F.col("_metadata.file_name"))


def clean_stream(raw: DataFrame, platform: str) -> DataFrame:
    """The app cleaning (C2-C4, C10) applied to a stream, tagged with the
    platform; rows a step would drop are dropped."""
    return clean_app(raw).withColumn(S.PLATFORM, F.lit(platform))


def start_ledger_stream(spark: SparkSession, folder: str, table_path: str, checkpoint: str | None,
                        platform: str, fmt: str = "csv", available_now: bool = True):
    """Append cleaned rows of new export files to ``table_path`` (Parquet,
    partitioned by platform).  ``checkpoint`` must be a shared folder; when
    None it is ``<spark.checkpoint.dir>/streams/ledger-<platform>-<key>``
    (key = a digest of the source and target paths), so a restarted stream
    finds its progress again and two streams never share one.  Returns the
    ``StreamingQuery``."""
    if checkpoint is None:
        import hashlib
        from ..session import ensure_checkpoint_dir
        key = hashlib.sha1(f"{folder}|{table_path}".encode()).hexdigest()[:12]
        checkpoint = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/ledger-{platform}-{key}"
    cleaned = clean_stream(read_exports(spark, folder, fmt), platform)
    w = (cleaned.writeStream.format("parquet").option("path", table_path)
         .option("checkpointLocation", checkpoint).partitionBy(S.PLATFORM).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
