"""M17 run twice for one platform: the second run replaces the first."""

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.plans import pipeline as PL
from ledgerlens.plans.queries import TEST_KEYWORDS, _scratch
from ledgerlens.sources import io as IO
from ledgerlens.sources import tables as TB


def _counts(tables):
    return {name: df.count() for name, df in tables.items()}


def test_second_run_replaces_the_first_also_by_nothing(spark, monkeypatch):
    out = _scratch(spark, "analysis-test")
    raw, report = TB.raw_sales(spark, SF001), TB.deadstock_report(spark, SF001)
    monkeypatch.setitem(S.DEADSTOCK_RULE_PARAMS, "General", (0.003, 0.1))
    first = PL.run_pipeline(spark, raw, report, out, keywords=TEST_KEYWORDS)
    one = _counts(first)
    report_row = first["cleaning_report"].first()
    assert report_row.dropped_dates > 0 and report_row.dropped_numeric > 0
    assert one["change_log"] == one["bundling_similarity"]
    dead = {r[0] for r in first["deadstock"].collect()}
    assert dead <= {r[0] for r in first["barang"].select(S.ITEM_ID).collect()}
    partner = {r[0] for r in first["similarity"].select("id_barang_2").collect()}
    assert partner <= dead
    assert one["bundling_ds"] > 0
    # no dead-stock rule can reach this preset: last run's bundles must go
    monkeypatch.setitem(S.DEADSTOCK_RULE_PARAMS, "General", (1.0, 1.0))
    two = _counts(PL.run_pipeline(spark, raw, report, out, keywords=TEST_KEYWORDS))
    assert two["bundling_ds"] == two["bundling_ds_item"] == 0
    assert {k: v for k, v in two.items() if "_ds" not in k} == {k: v for k, v in one.items() if "_ds" not in k}
    # another platform's run leaves this one's tables alone
    PL.run_pipeline(spark, raw, report, out, platform="Shopee", keywords=TEST_KEYWORDS)
    table = IO.VersionedTable(spark, f"{out}/barang")
    assert table.read(first["barang"].schema, "General").count() == one["barang"]


def test_files_of_another_platform_stop_the_run(spark, tmp_path):
    raw, report = TB.raw_sales(spark, SF001), TB.deadstock_report(spark, SF001)
    raw.limit(5).write.parquet(str(tmp_path / "penjualan_lazada"))
    files = spark.read.parquet(str(tmp_path / "penjualan_lazada"))
    with pytest.raises(ValueError, match="Shopee"):
        PL.run_pipeline(spark, raw, report, str(tmp_path / "out"), platform="Shopee", sales_files=files)
    assert not (tmp_path / "out").exists()


def test_only_what_changed_runs_again(spark):
    out = _scratch(spark, "analysis-rerun")
    raw, report = TB.raw_sales(spark, SF001), TB.deadstock_report(spark, SF001)

    def run(raw, report, **kw):
        written = []
        tables = PL.run_pipeline(spark, raw, report, out, keywords=TEST_KEYWORDS, written=written, **kw)
        return written, tables

    written, first = run(raw, report)
    assert set(written) | {"quarantine"} == set(first) | {"ledger"}
    one, names = _counts(first), {r.deskripsi_brg: r.id_barang for r in first["item_ids"].collect()}
    # nothing changed, though rows and columns come in another order
    written, again = run(raw.repartition(5).select(*reversed(raw.columns)).select(*raw.columns), report)
    assert written == [] and _counts(again) == one
    # one name more is dead: cleaning stays, all from the products on runs again
    more = report.unionByName(spark.createDataFrame([(0, "a new dead thing", "LARGE", "100")], report.schema))
    written, third = run(raw, more)
    assert {"ledger", "cleaning_report"}.isdisjoint(written)
    assert {"item_ids", "barang_loaded", "deadstock", "barang"} <= set(written)
    ids = {r.deskripsi_brg: r.id_barang for r in third["item_ids"].collect()}
    assert {k: ids[k] for k in names} == names and ids["a new dead thing"] == max(names.values()) + 1
    # a part of the sales only: the products that are left have their ids
    written, fourth = run(raw.where(F.col(S.RAW_NOTA).cast("long") % 2 == 0), report)
    assert {"ledger", "penjualan"} <= set(written)
    left = {r.deskripsi_brg: r.id_barang for r in fourth["barang_loaded"].collect()}
    assert 0 < len(left) and all(ids[k] == v for k, v in left.items())


def test_the_raw_ledger_is_read_once_by_the_first_run(spark):
    """Cleaning, report, quarantine and fingerprint come from one pass."""
    reads = spark.sparkContext.accumulator(0)
    raw = TB.raw_sales(spark, SF001).limit(500).cache()
    n = raw.count()

    @F.udf("string")
    def seen(x):
        reads.add(1)
        return x

    marked = raw.withColumn(S.RAW_NOTA, seen.asNondeterministic()(S.RAW_NOTA))
    report = TB.deadstock_report(spark, SF001)
    PL.run_pipeline(spark, marked, report, _scratch(spark, "analysis-once"), keywords=TEST_KEYWORDS)
    raw.unpersist()
    assert reads.value == n
