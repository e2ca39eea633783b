"""Column expressions: cut points, ladders, keyword order, cleaners."""

import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions import columns as C
from ledgerlens.operators import segment as G


def _one(spark, expr, value, dtype):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr("v").alias("o")).first()["o"]


@pytest.mark.parametrize("days,score", [(0, 5), (1, 4), (7, 4), (8, 3), (30, 3), (31, 2), (90, 2), (91, 1)])
def test_recency_bounds(spark, days, score):
    assert _one(spark, C.score_recency, days, "int") == score


@pytest.mark.parametrize("v,score", [(1200, 5), (1199, 4), (600, 4), (599, 3), (300, 3), (299, 2),
                                     (120, 2), (119, 1), (0, 1)])
def test_flat_frequency_cuts(spark, v, score):
    assert _one(spark, lambda c: C.score_cuts(c, S.FLAT_F_THRESHOLDS), v, "int") == score


def _ladder_a(r, f, m):
    # the segment ladder written out as plain Python for the check
    if r > 3 and f > 4:
        return S.CAT_TRENDING
    if r > 3 and f > 3:
        return S.CAT_FAST
    if r > 4 and f < 3:
        return S.CAT_LOYAL
    if r > 4 and 3 < f < 5:
        return S.CAT_POTENTIAL
    if 1 < f < 5 and m < 4:
        return S.CAT_AVERAGE
    if r > 2 and f <= 2:
        return S.CAT_STAGNANT
    if f < 2 and m < 2:
        return S.CAT_DEADSTOCK
    if m > 1:
        return S.CAT_CONSUMABLE
    return S.CAT_UNCATEGORIZED


def _ladder_b(f, m):
    if f > 4:
        return S.CAT_TRENDING
    if f > 3:
        return S.CAT_FAST
    if m > 4 and f < 3:
        return S.CAT_LOYAL
    if m > 3 and 3 < f < 5:
        return S.CAT_POTENTIAL
    if 1 < f < 5 and m < 4:
        return S.CAT_AVERAGE
    if m > 3 and f <= 2:
        return S.CAT_STAGNANT
    if f < 2 and m < 2:
        return S.CAT_DEADSTOCK
    if m > 1:
        return S.CAT_CONSUMABLE
    return S.CAT_UNCATEGORIZED


def test_all_125_ladder_triples(spark):
    triples = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(triples, "r int, f int, m int")
    got = {(r["r"], r["f"], r["m"]): (r["a"], r["b"]) for r in
           df.select("r", "f", "m", C.category_rfm("r", "f", "m").alias("a"),
                     C.category_fm("f", "m").alias("b")).collect()}
    for r, f, m in triples:
        assert got[(r, f, m)] == (_ladder_a(r, f, m), _ladder_b(f, m))
    # with R fixed at 5 (app variant) dead stock is unreachable
    assert all(got[(5, f, m)][0] != S.CAT_DEADSTOCK for f in range(1, 6) for m in range(1, 6))


@pytest.mark.parametrize("group,expected", [("MESIN CHAINSAW", "chainsaw"), ("ABC", "other"),
                                            ("spare part diesel", "mesin"), ("Optical", "powertool"),
                                            (None, "other")])
def test_product_type_keyword_order(spark, group, expected):
    assert _one(spark, C.product_type, group, "string") == expected


def test_unknown_type_scores(spark):
    df = spark.createDataFrame([("other", 0), ("other", -1)], "t string, v int")
    got = [r[0] for r in df.select(C.score_by_type("v", "t", S.F_THRESHOLDS)).collect()]
    assert got == [5, 1]


@pytest.mark.parametrize("raw,expected", [("1,5", 1.5), ("-3", 3.0), ("1.234,5", None), (None, None),
                                          (" 7 pcs", 7.0)])
def test_notebook_quantity_cleaner(spark, raw, expected):
    assert _one(spark, C.clean_qty_text, raw, "string") == expected


@pytest.mark.parametrize("raw,expected", [("2.9", 2), ("x", None), ("-2.9", -2), ("10", 10)])
def test_app_quantity_cleaner(spark, raw, expected):
    assert _one(spark, C.coerce_qty_int, raw, "string") == expected


def test_bad_date_dropped_and_counted(spark):
    raw = spark.createDataFrame(
        [("N1", "31/31/2020", "A", "G", "1"), ("N2", "2020-01-05", "B", "G", "x"),
         ("N3", "2020-01-06", None, "G", "1"), ("N4", "2020-01-07", "C", "G", "2")],
        "`Kode Nota` string, Tanggal string, `Deskripsi Brg` string, `Jenis Barang` string, Jml string")
    rep = G.cleaning_report(raw).first().asDict()
    assert rep == {"initial_rows": 4, "dropped_dates": 1, "dropped_other": 1, "dropped_numeric": 1,
                   "kept_rows": 1}
    assert [r["kode_nota"] for r in G.clean_app(raw).collect()] == ["N4"]


def test_leap_day_window(spark):
    df = spark.createDataFrame([(datetime(2024, 2, 29),), (datetime(2023, 2, 28),), (datetime(2023, 2, 27),)],
                               "tanggal timestamp")
    kept = sorted(r[0] for r in G.trailing_window(df, 1).collect())
    assert kept == [datetime(2023, 2, 28), datetime(2024, 2, 29)]


def test_sheet_label():
    assert C.sheet_label(0.001, 0.1) == "Sup0.001_Conf0.1_Rules"


def test_clean_product_name(spark):
    assert _one(spark, C.clean_product_name, ' "Bor\n" ', "string") == "Bor"
    assert _one(spark, C.normalise_name, "  Bor KAYU ", "string") == "bor kayu"


def test_decode_validity(spark):
    df = spark.createDataFrame([("x",), ("ok",), (None,)], "v string")
    assert [r[0] for r in df.select(C.decode_validity("v")).collect()] == [0, 1, 1]


def test_rule_key_is_order_free(spark):
    df = spark.createDataFrame([(["b", "a"], ["c"]), (["a", "b"], ["c"])], "a array<string>, c array<string>")
    keys = {r[0] for r in df.select(C.rule_key("a", "c")).collect()}
    assert len(keys) == 1
    assert F is not None


def test_dates_are_read_month_first(spark):
    from datetime import datetime
    texts = ["05/03/2024", "25/03/2024", "31/31/2020", "2024-03-05", "2024-03-05 07:08:09", " 5/3/2024 ", "", "x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(C.coerce_timestamp("t")).collect()]
    assert got == [datetime(2024, 5, 3), datetime(2024, 3, 25), None, datetime(2024, 3, 5),
                   datetime(2024, 3, 5, 7, 8, 9), datetime(2024, 5, 3), None, None, None]
    stamped = spark.createDataFrame([(datetime(2024, 1, 2, 3),)], "t timestamp")
    column = C.coerce_timestamp("t", stamped.schema["t"].dataType)
    assert stamped.select(column).first()[0] == datetime(2024, 1, 2, 3)


def test_quantities_are_plain_numbers(spark):
    texts = ["3d", "4F", "2.9", "-2.9", "+7", ".5", "5.", "1e2", "inf", "nan", "1,5", " 8 ", "", None, "99999999999"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(C.coerce_qty_int("t")).collect()]
    assert got == [None, None, 2, -2, 7, 0, 5, 100, None, None, None, 8, None, None, None]
