"""Roll-ups, one-pass cleaning, stable ids, profiles and export files."""

import pytest
from conftest import SF001, SF01, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerlens import schema as S
from ledgerlens.operators import joins as J
from ledgerlens.operators import segment as G
from ledgerlens.operators import similarity as SIM
from ledgerlens.plans import queries as Q
from ledgerlens.sources import io as IO
from ledgerlens.sources import tables as TB


# ------------------------------------------------------------------ windows

def test_three_windows_from_one_rollup_equal_three_windows(spark):
    lines = TB.sales_lines(spark, SF001)
    got = G.window_metrics(G.daily_rollup(lines))
    for y in (1, 2, 3):
        want = G.rfm_metrics(G.trailing_window(lines, y)).select(S.NAME, "recency", "frequency", "monetary")
        assert rows(got.where(F.col("years") == y), S.NAME, "recency", "frequency", "monetary") == rows(want)


def test_merged_rollups_are_those_of_all_lines(spark):
    lines = TB.sales_lines(spark, SF001)
    even = F.col(S.NOTA) % 2 == 0
    parts = [G.daily_rollup(lines.where(even)), G.daily_rollup(lines.where(~even))]
    assert rows(G.merge_rollups(*parts)) == rows(G.daily_rollup(lines))


def test_receipts_of_two_dates_are_refused(spark):
    schema = f"{S.NOTA} string, {S.DATE} timestamp"
    one = spark.createDataFrame([("a", None), (None, None)], schema).withColumn(S.DATE, F.current_timestamp())
    assert G.check_receipt_dates(one) is one
    with pytest.raises(G.SplitReceiptError, match="1 receipts"):
        G.check_receipt_dates(one.unionByName(one.withColumn(S.DATE, F.col(S.DATE) + F.expr("INTERVAL 1 DAY"))))
    G.check_receipt_dates(TB.sales_lines(spark, SF001, names=False))


def test_the_windows_read_the_ledger_once(spark):
    spark.catalog.clearCache()
    key = "spark.sql.optimizer.runtime.bloomFilter.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        plan = entry.queries()["A1_window_metrics"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    # the latest date and the metrics share the roll-up's exchange when it runs
    assert plan.count("ReusedExchange") + 1 >= plan.count("FileScan parquet [l_") or plan.count("FileScan parquet [l_") <= 2


# ----------------------------------------------------------------- cleaning

def test_cleaning_in_one_pass_equals_the_steps(spark, tmp_path):
    raw = TB.raw_sales(spark, SF01)
    got = G.clean_app_to(raw, str(tmp_path / "ledger"))
    want = G.clean_app(raw)
    assert rows(got.rows.select(*want.columns)) == rows(want)
    assert rows(got.report) == rows(G.cleaning_report(raw))
    assert got.quarantine.count() == got.counts["initial_rows"] - got.counts["kept_rows"] > 0
    assert {r.step for r in got.quarantine.select("step").collect()} == set(G.DROPPING_STEPS.values())
    # kept rows and the quarantine are the raw rows, each once
    back = got.quarantine.select(*raw.columns)
    assert back.exceptAll(raw).count() == 0 and back.count() + got.rows.count() == raw.count()
    assert got.fingerprint == int(raw.agg(F.sum(G.row_hash(raw))).first()[0])


def test_cleaning_an_empty_or_wholly_bad_ledger(spark, tmp_path):
    schema = ", ".join(f"`{c}` string" for c in S.RAW_COLUMNS)
    none = G.clean_app_to(spark.createDataFrame([], schema), str(tmp_path / "a"))
    assert none.rows.count() == none.quarantine.count() == 0 and none.fingerprint == 0
    assert set(none.counts.values()) == {0}
    bad = G.clean_app_to(spark.createDataFrame([("n", "31/31/2020", "x", "g", "1"), ("n", None, None, None, None)], schema),
                         str(tmp_path / "b"))
    assert bad.rows.count() == 0 and [r.step for r in bad.quarantine.collect()] == ["date", "date"]


def test_row_hashes_tell_where_a_null_is(spark):
    schema = "a string, b string"
    sums = {tuple(r): G.row_hash(df) for r in [("x", None), (None, "x"), ("x", "x")]
            for df in [spark.createDataFrame([r], schema)]}
    found = {r: spark.createDataFrame([r], schema).select(h).first()[0] for r, h in sums.items()}
    assert len(set(found.values())) == 3


# ---------------------------------------------------------------------- ids

def test_ids_stay_over_loads(spark):
    def load(names):
        return spark.createDataFrame([(n,) for n in names], "name string")
    order = [F.col("name")]
    one = J.merge_ids(None, load(["b", "a", None]), "name", order, "id")
    assert rows(one, "name", "id") == [("a", 1), ("b", 2)]
    two = J.merge_ids(one, load(["c", "a", "aa"]), "name", order, "id")
    assert rows(two, "name", "id") == [("a", 1), ("aa", 3), ("b", 2), ("c", 4)]
    assert rows(J.merge_ids(two, load([]), "name", order, "id")) == rows(two)
    assert rows(J.merge_ids(one.limit(0), load(["z"]), "name", order, "id"), "name", "id") == [("z", 1)]


def test_two_loads_have_products_of_both(spark):
    loads = [r.load for r in entry.queries()["G11_two_loads"](spark, SF01).select("load").collect()]
    assert set(loads) == {1, 2}


# ------------------------------------------------------------------ profile

def test_profile_of_all_kinds_of_columns(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'b', 1.5D, DATE '2020-01-02', true, TIMESTAMP '2020-01-01 00:00:00', 10.25),
      (10, 'a', -2D, DATE '2019-12-31', false, NULL, 9.5), (9, 'a', double('nan'), NULL, NULL, NULL, NULL),
      (NULL, NULL, NULL, NULL, NULL, NULL, NULL) AS t(i, s, d, day, flag, at, m)""").withColumnRenamed("s", "a name.x")
    got = {r.column_name: tuple(r)[3:] for r in IO.column_profile(df).collect()}
    assert got["i"] == (4, 3, 3, "1", "10") and got["a name.x"] == (4, 3, 2, "a", "b")
    assert got["d"] == (4, 3, 3, "-2.0", "NaN") and got["day"] == (4, 2, 2, "2019-12-31", "2020-01-02")
    assert got["flag"] == (4, 2, 2, "false", "true") and got["at"][:3] == (4, 1, 1)
    assert got["m"] == (4, 2, 2, "9.50", "10.25")
    assert [tuple(r)[3:] for r in IO.column_profile(df.limit(0)).collect()] == [(0, 0, 0, None, None)] * 7


# ------------------------------------------------------------------ exports

def test_exports_of_several_layouts(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "jual_shopee.csv").write_text(
        '﻿Kode Nota,Tanggal,Deskripsi Brg,Jenis Barang,Jml\nN1,2020-01-01,"bor, ""besar""",G,1\n\nN2,2020-01-01,x,G,2,surplus\nN3,2020-01-01,x\n',
        encoding="utf-8")
    (tmp_path / "x" / "jual_lain.csv").write_text("Cabang,Jml,Kode Nota,Tanggal,Deskripsi Brg,Jenis Barang\nT,5,N4,d,y,G\nT,,N5,d,y,G\n")
    (tmp_path / "x" / "tanpa.csv").write_text("Kode Nota,Tanggal\nN6,d\n")
    (tmp_path / "x" / "catatan.csv").write_text("hello\n")
    sales, bad = IO.load_exports(spark, str(tmp_path / "x"))
    assert rows(sales, *S.RAW_COLUMNS, IO.FILE) == [
        ("N1", "2020-01-01", 'bor, "besar"', "G", "1", "jual_shopee.csv"), ("N4", "d", "y", "G", "5", "jual_lain.csv")]
    assert rows(bad) == [("jual_shopee.csv", "N2,2020-01-01,x,G,2,surplus"), ("jual_shopee.csv", "N3,2020-01-01,x")]
    assert bad.count() == 2
    names = IO.export_names(spark, str(tmp_path / "x"))
    assert rows(IO.source_platform_violations(names, "SHOPEE")) == [("catatan.csv",), ("jual_lain.csv",), ("tanpa.csv",)]
    assert IO.source_platform_violations(names, "General").count() == 0
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "leer.csv").write_text("")
    with pytest.raises(ValueError, match="no exports"):
        IO.load_exports(spark, str(tmp_path / "y"))


# ------------------------------------------------------------------- cosine

def test_bounds_leave_fewer_candidates_and_every_pair(spark):
    """Candidates are far fewer than pairs that share an indexed token."""
    a, b = Q._detail_sides(spark, SF01)
    t = S.APP_SIMILARITY_THRESHOLD
    ix = SIM.candidate_index(SIM.tfidf(a, b), t)
    found = SIM.candidate_pairs(ix, t)
    sides = [ix.where(f"_pref AND side = '{x}'").select(F.col("id").alias(f"id_{x}"), "token") for x in "AB"]
    sharing = sides[0].join(sides[1], "token").select("id_A", "id_B").distinct().count()
    scored = SIM.cosine_pairs(a, b, t)
    assert scored.count() <= found.count() < sharing
    assert scored.join(found, ["id_1", "id_2"], "left_anti").count() == 0
