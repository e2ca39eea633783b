"""Session helpers.

The library never creates a session inside an operator; these helpers exist
for tests, the bench and the command line.  ``local_session`` sets them on the
session that it makes; on a cluster the caller's session is used as it is.
Dates are compared in the session's time zone, so a caller sets it to UTC.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators are written against.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "ledgerlens") -> SparkSession:
    """A local session for tests and the bench (UI off, no servers)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    unchanged.  Only where it is unset and the master is a plain ``local`` one
    (driver and executor in one process, as in tests) a scratch folder is
    made; elsewhere executors would write to disks of their own, so a missing
    setting is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is not set: on {master} it must name a folder "
                           "that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def materialise(df, name: str = "t"):
    """Write ``df`` once as a Parquet table under the session's shared
    checkpoint folder and return it read back.

    This is the lineage cut used for intermediates that are read more than
    once: later stages (and a retried task after a lost executor) read the
    table instead of recomputing the plan above it.  Parquet rather than
    ``checkpoint()``: columnar, compressed, and the read-back carries file
    sizes that Spark's broadcast size check can use."""
    import uuid
    spark = df.sparkSession
    path = f"{materialised_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df, name: str = "t"):
    """``materialise``, and the number of rows written (observed while they
    are written, so nothing is read for it)."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    seen = Observation(name)
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return out, int(seen.get["rows"])


def spread(df, *keys: str):
    """``df`` dealt out by ``keys`` over all of the session's shuffle partitions
    (Spark leaves that out where the rows lie by these keys already).

    For aggregates whose rows per task are held in memory: the aggregate then
    runs once, on whole groups, without partial sums of its own before."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialised_dir(spark: SparkSession) -> str:
    """The folder of this application's written intermediates:
    ``<spark.checkpoint.dir>/tables/<application id>``."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{spark.sparkContext.applicationId}"


def release_materialised(spark: SparkSession) -> bool:
    """Delete this application's written intermediates (the folder of
    ``materialised_dir``) through the Hadoop file system of that path, so it
    works for any shared store the cluster names.  Call it once the results
    that read them have been consumed; DataFrames built on them cannot be
    evaluated afterwards.  Returns whether anything was deleted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(materialised_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path) and fs.delete(path, True))
