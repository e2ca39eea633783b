"""Sources and sinks.

Workbooks become Parquet folders; a sheet becomes the value of a
``sheet`` partition column, a per-platform table becomes a ``platform``
partition.  Reads therefore prune partitions and columns for free.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


class MissingColumnsError(ValueError):
    """Raised with the names of the columns an input lacks."""


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail, naming the missing columns (schema only, no job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError("missing required columns: " + ", ".join(missing))
    return df


def select_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Project the wanted columns that exist, in wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def load_sales(frames: Iterable[DataFrame], columns: Sequence[str] = S.RAW_COLUMNS) -> DataFrame:
    """Keep the wanted columns each input has, union by name (missing
    columns become null), drop rows with any null.  An input that lacks a
    wanted column therefore contributes no rows."""
    parts = [select_existing(f, columns) for f in frames]
    if not parts:
        raise ValueError("no inputs")
    combined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    missing = [c for c in columns if c not in combined.columns]
    for c in missing:
        combined = combined.withColumn(c, F.lit(None).cast("string"))
    return combined.select(*[F.col(f"`{c}`") for c in columns]).na.drop("any")


#: Where a record that does not fit its file's layout is kept, and the name of
#: its export: a file's, or that of the folder that holds part files.
CORRUPT, FILE = "_corrupt_record", "file_name"


def _export_name() -> F.Column:
    name = F.col("_metadata.file_name")
    return F.when(name.startswith("part-"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).otherwise(name)


def _export_lines(spark: SparkSession, files) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(files)


def export_layouts(spark: SparkSession, path: str, columns: Sequence[str] = S.RAW_COLUMNS) -> dict[str, str]:
    """The header line of every CSV file below ``path``: file -> line.

    A header is a line that holds one of the wanted columns as a cell; only
    such lines leave the tasks, one per file (the file list itself is on the
    driver in any case).  A file without one has no layout."""
    heads = (_export_lines(spark, path).select(F.col("_metadata.file_path").alias("file"), "value")
             .where(F.arrays_overlap(_cells(F.col("value")), F.array(*[F.lit(c) for c in columns])))
             .groupBy("file").agg(F.first("value").alias("line")))
    return {r.file: r.line for r in heads.collect()}


def export_names(spark: SparkSession, path: str) -> DataFrame:
    """The names of the exports below ``path`` (``FILE``)."""
    return _export_lines(spark, path).select(_export_name().alias(FILE)).distinct()


def _cells(line: F.Column) -> F.Column:
    return F.transform(F.split(line, ","), lambda c: F.regexp_replace(F.trim(c), '^\ufeff?"?|"?$', ""))


def read_exports(spark: SparkSession, path: str, columns: Sequence[str] = S.RAW_COLUMNS) -> list[DataFrame]:
    """Frames of the CSV exports below ``path`` for ``load_sales``: one per
    layout, not per file, with a declared schema (text, so the cleaning
    decides), the file's name, and in ``CORRUPT`` the whole record if it has
    more or fewer cells than its header.  A record is a line."""
    layouts: dict[str, list[str]] = {}
    for file, line in export_layouts(spark, path, columns).items():
        layouts.setdefault(line, []).append(file)
    frames = []
    for line, files in sorted(layouts.items()):
        names = [c.strip().removeprefix("\ufeff").strip('"') for c in line.split(",")]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, CORRUPT)])
        record = F.from_csv("value", F.lit(schema.toDDL()),
                            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"'})
        frames.append(_export_lines(spark, sorted(files)).where((F.col("value") != line) & (F.trim("value") != ""))
                      .select(record.alias("_r"), _export_name().alias(FILE)).select("_r.*", FILE))
    return frames


def load_exports(spark: SparkSession, path: str, columns: Sequence[str] = S.RAW_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """S1/U1 on files: (sales with the file of each row, malformed records with
    theirs).  A file that lacks a wanted column contributes no rows; a
    malformed record is no sale."""
    frames = read_exports(spark, path, columns)
    if not frames:
        raise ValueError(f"no exports below {path}")
    bad = reduce(DataFrame.unionByName, [f.where(F.col(CORRUPT).isNotNull()).select(FILE, CORRUPT) for f in frames])
    return load_sales([f.where(F.col(CORRUPT).isNull()) for f in frames], [*columns, FILE]), bad


def load_workbook(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Every sheet of a written folder, the sheet's name as its last column.
    A workbook without rows has no file that would tell the columns: with
    ``schema`` it is a table without rows, without it an error."""
    if schema is None:
        return spark.read.parquet(path)
    names = [c for c in schema.fieldNames() if c != "sheet"]
    # an empty folder has no partition either
    return spark.read.schema(schema).parquet(path).select(*[F.col(f"`{c}`") for c in names], "sheet")


def load_sheet(spark: SparkSession, path: str, sheet: str, schema: T.StructType | None = None) -> DataFrame:
    """One named sheet of a sheet-partitioned Parquet folder (partition
    pruning); ``schema`` as in ``load_workbook``."""
    return load_workbook(spark, path, schema).where(F.col("sheet") == sheet)


def load_deadstock(df: DataFrame, name_col: str = S.RAW_NAME, flag: str = S.DEADSTOCK_FLAG) -> DataFrame:
    """S3: distinct names whose DS equals the string '100'."""
    require_columns(df, [name_col, "DS"])
    return (df.where(F.trim(F.col("DS").cast("string")) == flag)
            .select(F.col(f"`{name_col}`").alias(S.NAME)).distinct())


def load_purchases(df: DataFrame, name_col: str = S.RAW_NAME) -> DataFrame:
    """Distinct purchased product names."""
    return df.select(F.col(f"`{name_col}`").alias(S.NAME)).where(F.col(S.NAME).isNotNull()).distinct()


def platform_table(df: DataFrame, platform: str) -> DataFrame:
    """The rows of one platform of a platform-partitioned table."""
    return df.where(F.col(S.PLATFORM) == platform)


def write_sheets(df: DataFrame, path: str) -> None:
    """One partition per sheet, under its whole name; empty sheets produce
    no folder."""
    df.write.mode("overwrite").partitionBy("sheet").parquet(path)


def partition_path(path: str, partition_col: str, value: str) -> str:
    """The folder of one partition value (characters that a path cannot hold
    are escaped the way the partition reader unescapes them)."""
    return f"{path.rstrip('/')}/{partition_col}={quote(value, safe=' .,-_()+&@$;')}"


# --- tables that are replaced as a whole or per platform (S7) --------------
#
#   <path>/version=<v>/platform=<p>/*.parquet   written once, never changed
#   <path>/_current/<n>                         which version each platform has
#
# A replacement writes a new version and, only when that is complete, the next
# manifest.  Until then, and if the job is lost half way, readers have the old
# rows.

class TableConflict(RuntimeError):
    """Another writer committed at the same time, more often than retried."""


class VersionedTable:
    """A Parquet table whose platforms are replaced by switching a manifest."""

    def __init__(self, spark: SparkSession, path: str, partition_col: str | None = S.PLATFORM):
        self._spark, self.path, self._col = spark, path.rstrip("/"), partition_col
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._log = f"{self.path}/_current"

    def _numbers(self) -> list[int]:
        log = self._path(self._log)
        if not self._fs.exists(log):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(log) if f.getPath().getName().isdigit())

    def _load(self, number: int) -> dict:
        jvm = self._spark.sparkContext._jvm
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
            self._fs.open(self._path(f"{self._log}/{number}")), "UTF-8"))
        try:
            return json.loads(reader.readLine())
        finally:
            reader.close()

    def manifest(self) -> dict[str, dict]:
        """Folder of a partition -> its version and what the writer noted."""
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else {}

    def folder(self, value: str | None = None) -> str:
        """The name of a platform's folder within a version."""
        return partition_path("", self._col, value).lstrip("/") if value is not None else "."

    def new_version(self) -> str:
        return f"v{uuid.uuid4().hex}"

    def place(self, version: str, folder: str) -> str:
        return f"{self.path}/version={version}" + ("" if folder == "." else f"/{folder}")

    def commit(self, entries: dict[str, dict], whole: bool = False, tries: int = 20) -> None:
        """Make the entries current in one step: beside the other folders', or
        with ``whole`` instead of them.  The manifest is written aside and
        given the next number, which fails if another writer had it; then it
        is made again from what that one wrote."""
        jvm = self._spark.sparkContext._jvm
        conf = self._spark.sparkContext._jsc.hadoopConfiguration()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)
        none = self._spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        for _ in range(tries):
            numbers = self._numbers()
            after = {**({} if whole or not numbers else self._load(numbers[-1])), **entries}
            tmp = self._path(f"{self._log}/.{uuid.uuid4().hex}")
            out = self._fs.create(tmp, True)
            out.writeBytes(json.dumps(after) + "\n")
            out.close()
            try:
                files.rename(tmp, self._path(f"{self._log}/{numbers[-1] + 1 if numbers else 1}"), none)
                return
            except Py4JJavaError as e:
                self._fs.delete(tmp, False)
                if "FileAlreadyExists" not in str(e.java_exception.toString()):
                    raise
        raise TableConflict(self.path)

    def replace(self, df: DataFrame, value: str | None = None, **notes) -> None:
        """Write ``df`` as a new version: of one platform (its column is not
        written), or, without ``value``, of all platforms at once."""
        version = self.new_version()
        if value is not None:
            folder = self.folder(value)
            df.drop(self._col).write.parquet(self.place(version, folder))
            self.commit({folder: {"version": version, **notes}})
            return
        writer = df.write.partitionBy(self._col) if self._col else df.write
        base = f"{self.path}/version={version}"
        writer.parquet(base)
        folders = ["."] if not self._col else [
            f.getPath().getName() for f in self._fs.listStatus(self._path(base)) if f.isDirectory()]
        self.commit({f: {"version": version, **notes} for f in folders}, whole=True)

    def read(self, schema: T.StructType, value: str | None = None) -> DataFrame:
        """The current rows (``schema`` names the table's columns), of one
        platform if given.  Files that a reader has resolved stay until
        ``drop_old_versions``."""
        held = self.manifest()
        if value is not None:
            held = {k: v for k, v in held.items() if k == self.folder(value)}
        if not held:
            return self._spark.createDataFrame([], schema)
        places = [self.place(e["version"], f) for f, e in sorted(held.items())]
        return (self._spark.read.schema(schema).option("basePath", self.path).parquet(*places)
                .select(*[F.col(f"`{c}`") for c in schema.fieldNames()]))

    def drop_old_versions(self) -> int:
        """Delete the versions that no platform has now; returns how many.
        For a time without writers, and readers of replaced rows."""
        held = {f"version={e['version']}" for e in self.manifest().values()}
        old = [f.getPath() for f in self._fs.listStatus(self._path(self.path))
               if f.getPath().getName().startswith("version=") and f.getPath().getName() not in held]
        for p in old:
            self._fs.delete(p, True)
        return len(old)


def replace_table(df: DataFrame, path: str, partition_col: str | None = S.PLATFORM) -> VersionedTable:
    """Replace a whole table (partitioned by ``partition_col`` if given)
    in one step, after all of it is written."""
    out = VersionedTable(df.sparkSession, path, partition_col)
    out.replace(df)
    return out


def replace_partition(df: DataFrame, path: str, value: str, partition_col: str = S.PLATFORM,
                      **notes) -> VersionedTable:
    """One platform's rows go and ``df`` comes in their place, in one step
    after it is written; a load without rows empties the platform, and the
    other platforms are not touched.  A load that fails changes nothing."""
    out = VersionedTable(df.sparkSession, path, partition_col)
    out.replace(df, value, **notes)
    return out


def source_platform_violations(df: DataFrame, platform: str) -> DataFrame:
    """For a non-General platform every input file name must contain the
    platform keyword (case-insensitive).  Returns the offending file names."""
    name = F.col(FILE) if FILE in df.columns else F.col("_metadata.file_name")
    files = df.select(name.alias("file_name")).distinct()
    if platform == "General":
        return files.where(F.lit(False))
    return files.where(~F.lower(F.col("file_name")).contains(platform.lower()))


def has_rows(df: DataFrame) -> bool:
    """Does the table hold at least one row (reads one row at most)."""
    return not df.isEmpty()


def tables_status(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count and whether it is non-empty.
    Every count is a distributed aggregate; the union holds one row per table."""
    rows = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            for name, t in tables.items()]
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumn("has_rows", F.col("n_rows") > 0)


def column_profile(df: DataFrame) -> DataFrame:
    """Every column in order with its type, rows, non-null and distinct
    values, the least and the greatest (as text; numbers and dates by value).

    One read: a row becomes one (column, value) pair per column, equal pairs
    are counted map-side, and a second aggregate sums up each column.  A value
    in most rows, and a column with as many values as rows, spread alike."""
    ordered = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)

    def pair(i: int, f: T.StructField) -> F.Column:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            size = F.unix_micros(col.cast("timestamp")).cast("decimal(38,10)")
        elif isinstance(f.dataType, T.DateType):
            size = F.unix_date(col).cast("decimal(38,10)")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            size = col.cast("double")  # kept apart below: a double may be no decimal
        else:
            size = col.cast("decimal(38,10)") if isinstance(f.dataType, ordered) else F.lit(None)
        real = isinstance(f.dataType, (T.FloatType, T.DoubleType))
        return F.struct(F.lit(i + 1).alias("pos"), (F.lit(None) if real else size).cast("decimal(38,10)").alias("exact"),
                        (size if real else F.lit(None)).cast("double").alias("real"), col.cast("string").alias("value"))

    fields = df.schema.fields
    pairs = df.select(F.explode(F.array(*[pair(i, f) for i, f in enumerate(fields)])).alias("p")).select("p.*")
    values = pairs.groupBy("pos", "exact", "real", "value").agg(F.count(F.lit(1)).alias("n"))
    size = F.struct("exact", "real", "value")
    here = F.col("value").isNotNull()
    out = values.groupBy("pos").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias("n_values"),
        F.count("value").alias("n_distinct"), F.min(F.when(here, size)).alias("_lo"), F.max(F.when(here, size)).alias("_hi"))
    names = df.sparkSession.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)],
        "pos int, column_name string, data_type string")
    return names.join(out, "pos", "left").select(  # as many rows as columns
        "pos", "column_name", "data_type", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        F.col("_lo.value").alias("least"), F.col("_hi.value").alias("greatest"))


def head(df: DataFrame, order: Sequence, n: int = 5) -> DataFrame:
    """The first rows under ``order`` (distributed take-ordered)."""
    return df.orderBy(*order).limit(n)


def profile(df: DataFrame, basket: str = S.NOTA, item: str = S.NAME) -> DataFrame:
    """Row count, distinct baskets and distinct items in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.countDistinct(basket).alias("n_baskets"),
                  F.countDistinct(item).alias("n_items"))
