"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialise, materialised_dir

__all__ = ["commit_file", "ensure_checkpoint_dir", "fresh", "fresh_dir", "make_folder", "materialise", "narrow",
           "only_cache", "open_fs", "short_batches", "worker_cache",
           "shuffle_partitions", "table"]


#: Rows of an Arrow batch between Spark and Python: texts are long, and each
#: task holds a batch several times on both sides.
ARROW_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Fewer rows per Arrow batch, where the session has Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


_caches: list[dict] = []


def worker_cache() -> dict:
    """A dictionary of a module that its tasks keep for the next task of the
    same worker process, until a task of another operator runs there."""
    _caches.append({})
    return _caches[-1]


def only_cache(mine: dict | None = None) -> None:
    """At the start of a task: drop what other operators have kept in this
    worker, so that a chain of operators holds one's memory at a time.  Arrow's
    pool keeps the memory of batches that are gone; it gives that back as well."""
    for cache in _caches:
        if cache is not mine:
            cache.clear()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **cols: str) -> DataFrame:
    """Only the columns an operator reads, under its own names, so further
    columns of the caller cannot clash: ``narrow(df, doc_id="id", text="body")``."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in cols.items()])


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name, n = f"_{base}", 0
    while name in taken:
        n += 1
        name = f"_{base}{n}"
    return name


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's shared checkpoint folder."""
    return f"{materialised_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def open_fs(uri: str):
    """(pyarrow file system, path) of a folder or file that Spark names, for
    tasks that write or read whole files of another format than Spark's."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def make_folder(uri: str) -> str:
    files, path = open_fs(uri)
    files.create_dir(path, recursive=True)
    return uri


def commit_file(files, tmp: str, final: str) -> None:
    """Give a task's finished file its name.  A repeated or speculative task
    writes the same bytes under the same name, so whoever ends last is right."""
    files.move(tmp, final)
