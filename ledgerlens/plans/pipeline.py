"""The analysis run of the shop application, stage by stage.

clean -> trailing window -> product dimension (+ unsold dead stock) -> keyed
sales -> sold together -> RFM segmentation -> category dimension -> all-
product bundles -> similarity (+ purge) -> bundles with similar dead stock
-> dead-stock bundles.

Every stage is written as a versioned table (``sources.io.VersionedTable``)
under ``out_dir`` and the next stage reads it back: the written table is the
lineage cut, a lost executor only re-runs the current stage, and a stage that
fails leaves the platform its old rows.  Running one platform replaces only
that platform's rows (also by a stage without rows) — the original cleared
shared tables for every platform.

Beside every table stands what it was made from: the sums of the row hashes of
its inputs, and its parameters.  A stage whose inputs and parameters are those
of the current version is read, not computed; as content counts, and not time,
a stage that ran and wrote the same rows stops the rest from running.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.columns import row_hash
from ..operators import baskets as B
from ..operators import bundles as BU
from ..operators import rules as R
from ..operators import segment as G
from ..operators import similarity as SIM
from ..sources import io as IO

REQUIRED = [S.RAW_NOTA, S.RAW_DATE, S.RAW_NAME, S.RAW_GROUP, S.RAW_QTY]

#: Part of every fingerprint; to be raised when a stage computes differently.
STAGE_VERSION = 1


def content_of(df: DataFrame) -> int:
    """The sum of all rows' hashes (one read; 0 without rows)."""
    return int(df.agg(F.sum(row_hash(df))).first()[0] or 0)


class _Run:
    """The written tables of one platform, and what each holds."""

    def __init__(self, spark: SparkSession, out_dir: str, platform: str, written: list | None):
        self.spark, self.out_dir, self.platform = spark, out_dir.rstrip("/"), platform
        self.tables: dict[str, DataFrame] = {}
        self.content: dict[str, int] = {}
        self.written = [] if written is None else written

    def _place(self, name: str) -> tuple[IO.VersionedTable, str]:
        table = IO.VersionedTable(self.spark, f"{self.out_dir}/{name}")
        return table, table.folder(self.platform)

    def _open(self, table: IO.VersionedTable, folder: str, entry: dict) -> DataFrame:
        """Only this platform's folder is listed and read."""
        schema = T.StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(table.place(entry["version"], folder))

    def ledger(self, raw: DataFrame) -> G.CleanedLedger:
        """The cleaned ledger, its quarantine and report.  The first run reads
        the raw rows once; a later one reads them to see whether they are the
        same, and again if they are not."""
        table, folder = self._place("ledger")
        entry = table.manifest().get(folder)
        made_from = f"{STAGE_VERSION} {','.join(raw.columns)}"
        if entry and entry["made_from"] == made_from and entry["raw"] == content_of(raw):
            found = G.CleanedLedger(self._open(table, folder, entry), raw.columns, entry["counts"], entry["raw"])
        else:
            version = table.new_version()
            found = G.clean_app_to(raw, table.place(version, folder))
            table.commit({folder: {"version": version, "made_from": made_from, "raw": found.fingerprint,
                                   "counts": found.counts, "schema": found.schema.jsonValue()}})
            self.written.append("ledger")
        self.content["ledger"] = found.fingerprint
        return found

    def known(self, name: str) -> DataFrame | None:
        """The current rows of a table of this platform, if it has any version."""
        table, folder = self._place(name)
        entry = table.manifest().get(folder)
        return self._open(table, folder, entry) if entry else None

    def stage(self, names: str | Sequence[str], inputs: Sequence[str], params: dict,
              build: Callable[[], DataFrame | Sequence[DataFrame]]) -> DataFrame:
        """Tables that ``build`` makes from the named inputs and parameters."""
        names = [names] if isinstance(names, str) else list(names)
        made_from = hashlib.sha256(json.dumps(
            [STAGE_VERSION, names, {i: self.content[i] for i in inputs}, params], sort_keys=True, default=str
        ).encode()).hexdigest()
        places = [self._place(n) for n in names]
        entries = [table.manifest().get(folder) for table, folder in places]
        if not all(e and e["made_from"] == made_from for e in entries):
            made = build()
            for i, df in enumerate([made] if isinstance(made, DataFrame) else made):
                entries[i] = self._write(names[i], df, made_from)
        for name, (table, folder), entry in zip(names, places, entries):
            self.tables[name], self.content[name] = self._open(table, folder, entry), entry["content"]
        return self.tables[names[0]]

    def _write(self, name: str, df: DataFrame, made_from: str) -> dict:
        table, folder = self._place(name)
        version, seen = table.new_version(), Observation(name)
        df.observe(seen, F.sum(row_hash(df)).alias("content")).write.parquet(table.place(version, folder))
        entry = {"version": version, "made_from": made_from, "content": int(seen.get["content"] or 0),
                 "schema": df.schema.jsonValue()}
        table.commit({folder: entry})
        self.written.append(name)
        return entry


def run_pipeline(spark: SparkSession, raw_sales: DataFrame, dead_report: DataFrame, out_dir: str,
                 platform: str = "General", years: int = 1, segment_variant: str = "V4",
                 keywords=S.TYPE_KEYWORDS, ds_category_variant: str = "V1",
                 sales_files: DataFrame | None = None, written: list | None = None) -> dict[str, DataFrame]:
    """Run the stages of one platform whose inputs or parameters changed;
    returns all tables.  The names of those written are added to ``written``.

    ``sales_files`` is the ledger as read from files: a file whose name lacks
    the platform stops the run before anything is written (S9).  Product ids
    are kept from load to load (``item_ids``): a name has its id for good.

    ``segment_variant`` is the stored RFM (the app's V4 by default);
    ``ds_category_variant`` is the category source of dead-stock bundling
    (V1 by default: V4 fixes recency at 5 and so never labels dead stock)."""
    IO.require_columns(raw_sales, REQUIRED)
    IO.require_columns(dead_report, [S.RAW_NAME, "DS"])
    if sales_files is not None:
        wrong = [r.file_name for r in IO.source_platform_violations(sales_files, platform).limit(10).collect()]
        if wrong:
            raise ValueError(f"not files of {platform}: " + ", ".join(sorted(wrong)))
    run = _Run(spark, out_dir, platform, written)
    t = run.tables
    ledger = run.ledger(raw_sales)
    run.stage("cleaning_report", ["ledger"], {}, lambda: ledger.report)
    t["quarantine"] = ledger.quarantine

    clean = G.trailing_window(ledger.rows, years)
    run.content["dead_report"] = content_of(dead_report)
    loaded, window = ["ledger", "dead_report"], {"years": years}
    run.stage("item_ids", loaded, window, lambda: G.product_ids(clean, dead_report, known=run.known("item_ids")))
    run.stage("barang_loaded", [*loaded, "item_ids"], window,
              lambda: G.product_dimension(clean, dead_report, known=t["item_ids"]))
    run.stage("penjualan", ["ledger", "item_ids"], window, lambda: G.key_sales(clean, t["item_ids"]))

    def keyed_sales(product: str) -> DataFrame:
        return t["penjualan"].join(t[product].select(S.ITEM_ID, S.NAME, S.GROUP), S.ITEM_ID)

    keyed = ["penjualan", "barang_loaded"]
    run.stage("sold_together", keyed, {}, lambda: B.sold_together(keyed_sales("barang_loaded"), item=S.ITEM_ID))
    run.stage("deadstock_loaded", ["barang_loaded"], {},
              lambda: t["barang_loaded"].where(F.col("is_deadstock")).select(S.ITEM_ID))

    run.stage(["category", "rfm"], keyed, {"variant": segment_variant, "keywords": keywords},
              lambda: G.category_dimension(G.segment(keyed_sales("barang_loaded"), segment_variant, key=S.ITEM_ID,
                                                     keywords=keywords)))

    p_all, c_all = R.rule_params(platform)

    def all_bundles():
        header, items = BU.normalise_bundles(BU.bundle_all(keyed_sales("barang_loaded"), p_all, c_all), t["barang_loaded"])
        return header.drop("rule_key"), items

    run.stage(["bundling_all", "bundling_all_item"], keyed, {"support": p_all, "confidence": c_all}, all_bundles)

    def similar():
        names = t["barang_loaded"].select(F.col(S.ITEM_ID).alias("id"), F.col(S.NAME).alias("text"))
        sold = t["sold_together"].select(F.col(S.ITEM_ID).alias("id")).join(names, "id")
        dead = t["deadstock_loaded"].select(F.col(S.ITEM_ID).alias("id")).join(names, "id")
        pairs = SIM.cosine_pairs(sold, dead, S.APP_SIMILARITY_THRESHOLD)
        pairs, dead_left, product_left = SIM.purge_identical(pairs, t["deadstock_loaded"], t["barang_loaded"])
        return (pairs.select(F.col("id_1").alias("id_barang_1"), F.col("id_2").alias("id_barang_2"), "score"),
                dead_left, product_left)

    # the purged items leave both tables
    run.stage(["similarity", "deadstock", "barang"], ["sold_together", "deadstock_loaded", "barang_loaded"],
              {"threshold": S.APP_SIMILARITY_THRESHOLD}, similar)

    def replaced():
        header, items, changed = BU.replace_first(t["bundling_all"], t["bundling_all_item"], t["similarity"])
        return BU.change_log(t["bundling_all_item"], items, changed, t["barang"]), header, items

    run.stage(["change_log", "bundling_similarity", "bundling_similarity_item"],
              ["bundling_all", "bundling_all_item", "similarity", "barang"], {}, replaced)

    p_ds, c_ds = R.rule_params(platform, "deadstock")

    def dead_bundles():
        sales = keyed_sales("barang")
        seg = G.segment(sales, ds_category_variant, key=S.ITEM_ID, keywords=keywords)
        rules = BU.bundle_deadstock(sales, BU.name_category(seg, t["barang"]), [p_ds], [c_ds], item=S.NAME,
                                    line_key=S.ITEM_ID,
                                    line_category=seg.select(F.col(S.ITEM_ID).alias("item"), "category"))
        rules = R.dedup_rules(rules.select("rule_key", "antecedent", "consequent", "support", "lift", "confidence"))
        header, items = BU.normalise_bundles(rules, t["barang"])
        return header.drop("rule_key"), items

    run.stage(["bundling_ds", "bundling_ds_item"], ["penjualan", "barang"],
              {"support": p_ds, "confidence": c_ds, "variant": ds_category_variant, "keywords": keywords}, dead_bundles)
    return t


def pipeline_status(tables: dict[str, DataFrame]) -> DataFrame:
    """S10 over the written tables plus the M16 consistency verdict."""
    status = IO.tables_status(tables)
    check = BU.consistency(tables, {
        "bundling_all": (tables["bundling_all"], tables["bundling_all_item"]),
        "bundling_similarity": (tables["bundling_similarity"], tables["bundling_similarity_item"]),
        "bundling_ds": (tables["bundling_ds"], tables["bundling_ds_item"]),
    }, tables["barang"])
    return status.crossJoin(check.select("consistent"))
