"""Operators on literal rows: every boundary named in FIXTURES §3."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.ordered import global_rank, top_n_per_group
from ledgerlens.operators import baskets as B
from ledgerlens.operators import bundles as BU
from ledgerlens.operators import evaluate as EV
from ledgerlens.operators import rules as R
from ledgerlens.operators import segment as G
from ledgerlens.operators import similarity as SIM
from ledgerlens.sources import io as IO

from conftest import rows


def _lines(spark, data):
    return spark.createDataFrame(data, "kode_nota string, deskripsi_brg string")


def test_duplicate_line_kept_by_row_count_but_not_sold_together(spark):
    lines = _lines(spark, [("N1", "A"), ("N1", "A"), ("N2", "A"), ("N2", "B"), ("N3", "C")])
    kept = rows(B.multi_item_baskets(lines))
    assert ("N1", "A") in kept and ("N3", "C") not in kept
    bk = {r["kode_nota"]: r["items"] for r in B.baskets(B.multi_item_baskets(lines)).collect()}
    assert bk["N1"] == ["A"]                      # a one-item set, counted in n
    assert rows(B.sold_together(lines)) == [("A",), ("B",)]


def test_histogram_closed_last_bin(spark):
    data = []
    for width, nota in ((20, "W20"), (21, "W21"), (22, "W22")):
        data += [(nota, f"p{i}") for i in range(width)]
    data += [("S1", "a")]
    h = dict(rows(B.basket_width_histogram(_lines(spark, data))))
    assert h[20] == 2 and 21 not in h and 22 not in h and h[1] == 1


def test_basket_size_buckets(spark):
    lines = spark.createDataFrame([("f", "N1"), ("f", "N2"), ("f", "N2"), ("f", "N3"), ("f", "N3"), ("f", "N3")],
                                  "source string, kode_nota string")
    r = B.basket_size_buckets(lines).first()
    assert (r.n_one, r.n_two, r.n_more) == (1, 1, 1)
    assert math.isclose(r.pct_one, 100 / 3)


# -------------------------------------------------------------- similarity

def _brute_tfidf_cosine(a, b):
    """TF-IDF cosine written directly from the definition (smooth idf,
    raw tf, L2 norm) for the check."""
    docs = [t for _, t in a] + [t for _, t in b]
    tok = [re.findall(r"[^\W]{2,}", d.lower()) for d in docs]
    n = len(docs)
    df = Counter(t for ts in tok for t in set(ts))
    vecs = []
    for ts in tok:
        tf = Counter(ts)
        v = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vecs.append({t: x / norm for t, x in v.items()})
    out = {}
    for i, (ia, _) in enumerate(a):
        for j, (ib, _) in enumerate(b):
            s = sum(x * vecs[len(a) + j].get(t, 0.0) for t, x in vecs[i].items())
            if s > 0:
                out[(ia, ib)] = s
    return out


def test_cosine_matches_brute_force(spark):
    a = [(1, "Bor Kayu"), (2, "mata bor besi"), (3, "a b"), (4, "gergaji kayu 10mm")]
    b = [(10, "kayu BOR"), (11, "besi beton"), (12, "x y z"), (13, "bor bor bor")]
    da = spark.createDataFrame(a, "id long, text string")
    db = spark.createDataFrame(b, "id long, text string")
    got = {(r.id_1, r.id_2): r.score for r in SIM.cosine_pairs(da, db, 1e-6, postings_per_task=1).collect()}
    want = _brute_tfidf_cosine(a, b)
    assert set(got) == set(want)
    for k in want:
        assert math.isclose(got[k], want[k], rel_tol=1e-9)
        assert 0 <= got[k] <= 1 + 1e-12
    assert math.isclose(got[(1, 10)], 1.0)        # identical tokens
    assert not any(k[0] == 3 for k in got)        # one-letter tokens: no vector


def test_purge_identical_is_setwise(spark):
    pairs = spark.createDataFrame([(1, 10, 1.0), (2, 10, 0.4), (2, 11, 0.6)], "id_1 long, id_2 long, score double")
    dead = spark.createDataFrame([(10,), (11,)], "id_barang long")
    prod = spark.createDataFrame([(1,), (2,), (10,), (11,)], "id_barang long")
    p, d, pr = SIM.purge_identical(pairs, dead, prod)
    assert rows(p, "id_1", "id_2") == [(2, 11)]
    assert rows(d) == [(11,)] and rows(pr) == [(1,), (2,), (11,)]


def test_band_sampling_caps_per_band(spark):
    data = [(i, j, 0.15) for i in range(20) for j in range(10)] + [(0, 99, 0.55)]
    pairs = spark.createDataFrame(data, "id_1 long, id_2 long, score double")
    s = SIM.sample_bands(pairs, n=50)
    counts = dict(rows(s.groupBy("band").count()))
    assert counts == {"Range 0.1-0.199": 50, "Range 0.5-0.599": 1}
    assert rows(s) == rows(SIM.sample_bands(pairs.repartition(7), n=50))   # reproducible


# ------------------------------------------------------------------- rules

def test_grid_equals_per_cell_mining(spark):
    from conftest import SF001
    from ledgerlens.plans.queries import _all_product_baskets
    bk = _all_product_baskets(spark, SF001).cache()
    sup, conf = [0.02, 0.01, 0.005], [0.5, 0.1]
    grid = R.mine_grid(bk, sup, conf)
    for s in sup:
        for c in conf:
            label = f"Sup{s}_Conf{c}_Rules"
            one = R.mine_rules(bk, s, c)
            assert rows(grid.where(F.col("sheet") == label), "rule_key", "confidence", "support") == \
                rows(one, "rule_key", "confidence", "support"), label
    n = bk.count()
    ones = dict(rows(R.frequent_itemsets(bk, 0.005).where(F.size("items") == 1)
                     .select(F.col("items")[0], "freq")))
    for r in R.mine_rules(bk, 0.005, 0.1).collect():
        assert r.support * n >= math.ceil(0.005 * n) - 1e-9
        assert math.isclose(r.lift, r.confidence / (ones[r.consequent[0]] / n), rel_tol=1e-9)


def test_rule_status_first_in_grid_order(spark):
    df = spark.createDataFrame([("k1", 0), ("k1", 3), ("k2", 1)], "rule_key string, grid_ord int")
    st = dict(((r.rule_key, r.grid_ord), r.status) for r in R.rule_status(df).collect())
    assert st == {("k1", 0): "new", ("k1", 3): "existing", ("k2", 1): "new"}


def test_rules_touching_and_categories(spark):
    rules = spark.createDataFrame([(["a", "b"], ["c"]), (["x"], ["y"])], "antecedent array<string>, consequent array<string>")
    rules = rules.withColumn("rule_key", F.concat_ws("|", "antecedent", "consequent"))
    cats = spark.createDataFrame([("b", S.CAT_DEADSTOCK), ("a", "Loyal")], "item string, category string")
    kept = R.rule_categories(R.rules_touching(rules, cats), cats).collect()
    assert len(kept) == 1
    assert kept[0].Antecedent_Category == ["Loyal", S.CAT_DEADSTOCK]
    assert kept[0].Consequent_Category == [S.UNKNOWN_CATEGORY]


def test_no_deadstock_basket_gives_empty_typed_result(spark):
    lines = spark.createDataFrame([("N1", "A"), ("N1", "B")], "kode_nota string, deskripsi_brg string")
    cats = spark.createDataFrame([("A", "Loyal"), ("B", "Loyal")], "item string, category string")
    out = BU.bundle_deadstock(lines, cats, [0.5], [0.5])
    assert out.count() == 0 and "status" in out.columns and "Antecedent_Category" in out.columns


# ----------------------------------------------------------------- bundles

def test_replace_first_vs_replace_all(spark):
    header = spark.createDataFrame([(1, 0.1, 2.0, 0.5)], "id_bundling long, support double, lift double, confidence double")
    items = spark.createDataFrame([(1, 1, "antecedent"), (1, 2, "antecedent"), (1, 3, "consequent")],
                                  "id_bundling long, id_barang long, role string")
    sim = spark.createDataFrame([(1, 10, 0.5), (2, 20, 0.9), (1, 11, 0.9)],
                                "id_barang_1 long, id_barang_2 long, score double")
    _, ni, ch = BU.replace_first(header, items, sim)
    assert rows(ni) == [(1, 2, "antecedent"), (1, 3, "consequent"), (1, 10, "antecedent")]
    assert rows(ch, "old_id", "new_id") == [(1, 10)]
    _, ni2, _ = BU.replace_first(header, items, sim, best_score=True)
    assert (1, 11, "antecedent") in rows(ni2)

    rules = spark.createDataFrame([(["A", "B"], ["C"], 0.5, 2.0, 0.1)],
                                  "antecedent array<string>, consequent array<string>, confidence double, lift double, support double")
    rules = rules.withColumn("rule_key", F.lit("k"))
    pairs = spark.createDataFrame([("A", "dA", 0.9), ("B", "dB", 0.8), ("C", "dC", 0.7)], "sold string, dead string, score double")
    out = BU.replace_all_in_side(rules, pairs).first()
    assert out.antecedent_replaced == ["dA", "dB"] and out.consequent_replaced == ["C"]
    assert out.replaced_item == "B"


def test_orphans_counted_without_pairs(spark):
    header = spark.createDataFrame([(1,), (2,)], "id_bundling long")
    items = spark.createDataFrame([(1, 1, "antecedent"), (1, 99, "antecedent"), (1, 3, "consequent"),
                                   (2, 1, "antecedent"), (2, 3, "consequent")],
                                  "id_bundling long, id_barang long, role string")
    prod = spark.createDataFrame([(1,), (3,)], "id_barang long")
    assert BU.orphan_bundles(header, items, prod).first().orphans == 1


# -------------------------------------------------------------- evaluation

def test_precision_at_k_small_n(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 0), (1, 3, 0.7, 1)],
                                  "id_1 long, id_2 long, score double, valid int")
    got = {r.k: r.precision for r in EV.precision_at(pairs, ks=[1, 2, 5]).collect()}
    assert got == {1: 1.0, 2: 0.5, 5: 2 / 5}       # divides by k even when N < k
    rules = spark.createDataFrame([("a", 0.9, 1), ("b", 0.8, 0), ("c", 0.7, 1)],
                                  "rule_key string, support double, validity int")
    curve = {r.k: r.precision for r in EV.precision_at_k(rules).collect()}
    assert curve == {1: 1.0, 2: 0.5, 3: 2 / 3}     # curve stops at N


def test_rules_before_first_invalid(spark):
    rules = spark.createDataFrame([("s", "a", 0.9, 1), ("s", "b", 0.8, 1), ("s", "c", 0.7, 0), ("s", "d", 0.6, 1),
                                   ("t", "a", 0.5, 1)], "sheet string, rule_key string, support double, validity int")
    got = dict(rows(EV.rules_before_first_invalid(rules)))
    assert got == {"s": 2, "t": 1}


def test_global_rank_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).alias("x"))
    ranked = global_rank(df, [F.col("v").desc()], rank_col="k", running={"cx": F.col("x")}, partitions=7)
    got = sorted((r.k, r.v, r.cx) for r in ranked.collect())
    vals = sorted(((r.v, r.x) for r in df.collect()), reverse=True)
    cum, want = 0, []
    for i, (v, x) in enumerate(vals, 1):
        cum += x
        want.append((i, v, float(cum)))
    assert got == want


def test_top_n_per_group_exact(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    top = top_n_per_group(df, ["g"], [F.col("v").desc()], 5, salt_buckets=8)
    got = rows(top, "g", "v")
    want = sorted((g, v) for g in range(3) for v in sorted(range(g, 3000, 3), reverse=True)[:5])
    assert got == want


# ---------------------------------------------------------------------- io

def test_load_sales_file_missing_column_contributes_nothing(spark):
    full = spark.createDataFrame([("N1", "2020-01-01", "A", "G", "1")],
                                 "`Kode Nota` string, Tanggal string, `Deskripsi Brg` string, `Jenis Barang` string, Jml string")
    partial = full.drop("Jenis Barang").withColumn("Kode Nota", F.lit("N2"))
    out = IO.load_sales([full, partial])
    assert [r["Kode Nota"] for r in out.collect()] == ["N1"]


def test_require_columns_names_missing(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(IO.MissingColumnsError, match="Kode Nota, DS"):
        IO.require_columns(df, ["a", "Kode Nota", "DS"])


def test_sheets_roundtrip_and_partition_overwrite(spark, tmp_path):
    label = "Sup0.001_Conf0.1_Rules_and_more_text"
    df = spark.createDataFrame([(label, 1), (label + "2", 3), ("B", 2)], "sheet string, v int")
    IO.write_sheets(df, str(tmp_path / "wb"))
    back = IO.load_sheet(spark, str(tmp_path / "wb"), label)
    assert [r.v for r in back.collect()] == [1]
    t = spark.createDataFrame([("General", 1), ("Shopee", 2)], "platform string, v int")
    IO.replace_table(t, str(tmp_path / "tbl"))
    back = IO.replace_partition(spark.createDataFrame([(3,)], "v int"), str(tmp_path / "tbl"), "Shopee")
    assert rows(back.read(t.schema), "platform", "v") == [("General", 1), ("Shopee", 3)]


def test_source_platform_check(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "Penjualan_Shopee_1.parquet"))
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "Penjualan_Lazada_1.parquet"))
    df = spark.read.parquet(str(tmp_path / "Penjualan_Shopee_1.parquet"), str(tmp_path / "Penjualan_Lazada_1.parquet"))
    bad = [r.file_name for r in IO.source_platform_violations(df, "Shopee").collect()]
    assert bad and all("shopee" not in b.lower() for b in bad)
    assert IO.has_rows(df)


def test_classification_sets_add_up(spark):
    lines = _lines(spark, [("N1", "A"), ("N1", "B"), ("N2", "C"), ("N3", "D"), ("N4", "D")])
    dead = spark.createDataFrame([("E",)], "deskripsi_brg string")
    bought = spark.createDataFrame([("F",), ("A",)], "deskripsi_brg string")
    cls = {}
    for r in G.classify_products(lines, dead, bought).collect():
        cls.setdefault(r["class"], set()).add(r.product)
    assert cls["Sold Together"] == {"A", "B"} and cls["Sold Alone"] == {"C"}
    assert cls["Not Sold"] == {"E"} and cls["Unclassified"] == {"D", "F"}
    assert cls["All Products"] == {"A", "B", "C"}


@pytest.mark.parametrize("t", [0.05, 0.2, 0.5, 0.9])
def test_bounded_index_cosine_is_exact(spark, t):
    words = ["bor", "kayu", "besi", "mata", "the", "and", "of", "gergaji", "baut", "selang", "mesin"]
    a = [(i, " ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 5)) + " the and") for i in range(12)]
    b = [(100 + j, " ".join(words[(j * 3 + k) % len(words)] for k in range(1 + j % 6)) + " of the") for j in range(30)]
    da = spark.createDataFrame(a, "id long, text string")
    db = spark.createDataFrame(b, "id long, text string")
    got = {(r.id_1, r.id_2): r.score for r in SIM.cosine_pairs(da, db, t, postings_per_task=3).collect()}
    want = {k: v for k, v in _brute_tfidf_cosine(a, b).items() if v > t}
    assert set(got) == set(want)
    for k in want:
        assert math.isclose(got[k], want[k], rel_tol=1e-9)


def test_window_cut_on_orders_equals_window_on_ledger(spark):
    from conftest import SF001
    from ledgerlens.sources import tables as TB
    early = TB.sales_lines(spark, SF001, years=1)
    late = G.trailing_window(TB.sales_lines(spark, SF001), 1)
    cols = ["kode_nota", "id_barang", "jml", "tanggal"]
    assert rows(early, *cols) == rows(late, *cols)


@pytest.mark.parametrize("s,c", [(0.01, 0.1), (0.003, 0.5)])
def test_rules_from_itemsets_equal_mllib_rules(spark, s, c):
    """The rules derived from the written itemsets are MLlib's own rules,
    metric for metric (same operations, same order)."""
    from conftest import SF001
    from ledgerlens.sources import tables as TB
    bk = B.baskets(B.multi_item_baskets(TB.sales_lines(spark, SF001))).select("items")
    ours = R.mine_rules(bk, s, c)
    model = R._fit(bk, s, c)
    ref = model.associationRules.select(F.array_sort("antecedent").alias("antecedent"),
                                        F.array_sort("consequent").alias("consequent"),
                                        "confidence", "lift", "support")
    key = lambda r: (tuple(r.antecedent), tuple(r.consequent))
    a = {key(r): (r.confidence, r.lift, r.support) for r in ours.collect()}
    b = {key(r): (r.confidence, r.lift, r.support) for r in ref.collect()}
    assert len(a) > 0
    assert a == b


def test_rfm_reference_date_counts_lines_without_a_key(spark):
    """The reference date is the latest line overall, even when that line
    has no product (it is taken from the group maxima, null group included)."""
    import datetime as dt
    rows_ = [("n1", dt.datetime(2024, 1, 1), "a", 2), ("n2", dt.datetime(2024, 1, 11), None, 1),
             ("n3", dt.datetime(2024, 1, 5), "b", 3)]
    lines = spark.createDataFrame(rows_, f"{S.NOTA} string, {S.DATE} timestamp, {S.NAME} string, {S.QTY} int")
    got = {r[S.NAME]: r.recency for r in G.rfm_metrics(lines).collect()}
    assert got == {"a": 10, "b": 6}


def test_release_materialised_removes_only_this_apps_tables(spark):
    from ledgerlens.session import materialise, materialised_dir, release_materialised
    import os
    t = materialise(spark.range(5), "probe")
    assert t.count() == 5
    folder = materialised_dir(spark)
    assert spark.sparkContext.applicationId in folder
    assert release_materialised(spark) is True
    assert not os.path.exists(folder.replace("file:", ""))
    assert release_materialised(spark) is False


def test_replace_partition_keeps_other_platforms_and_session_setting(spark, tmp_path):
    """Only the platform's own rows are replaced, also by no rows, and
    the session's setting is not touched."""
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    path = str(tmp_path / "t")
    schema = "platform string, v int"
    IO.replace_table(spark.createDataFrame([("Shopee", 1), ("Lazada", 2), ("a/b:c d", 9)], schema), path)
    IO.replace_partition(spark.createDataFrame([("Shopee", 5), ("Shopee", 6)], schema), path, "Shopee")
    IO.replace_partition(spark.createDataFrame([("a/b:c d", 8)], schema), path, "a/b:c d")
    table = IO.VersionedTable(spark, path)
    got = lambda: sorted((r.platform, r.v) for r in table.read(spark.createDataFrame([], schema).schema).collect())
    assert got() == [("Lazada", 2), ("Shopee", 5), ("Shopee", 6), ("a/b:c d", 8)]
    IO.replace_partition(spark.createDataFrame([], schema), path, "Shopee")
    assert got() == [("Lazada", 2), ("a/b:c d", 8)]
    IO.replace_table(spark.createDataFrame([("Lazada", 1)], schema), path)
    assert got() == [("Lazada", 1)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_hot_tokens_give_the_same_scores(spark, monkeypatch):
    """Every token hot, and every shared token split over salts."""
    monkeypatch.setattr(SIM, "HOT_POSTINGS", 1)
    monkeypatch.setattr(SIM, "HOT_TOKENS", 10**9)
    words = ["bor", "kayu", "besi", "mata", "the", "and"]
    a = [(i, " ".join(words[(i * k) % 6] for k in range(1, 3 + i % 4))) for i in range(15)]
    b = [(100 + j, " ".join(words[(j + 2 * k) % 6] for k in range(2 + j % 5))) for j in range(25)]
    da, db = (spark.createDataFrame(x, "id long, text string") for x in (a, b))
    got = {(r.id_1, r.id_2): r.score for r in SIM.cosine_pairs(da, db, 0.2, postings_per_task=2).collect()}
    want = {k: v for k, v in _brute_tfidf_cosine(a, b).items() if v > 0.2}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    with pytest.raises(ValueError):
        SIM.cosine_pairs(da, db, 0)


@pytest.mark.parametrize("name", ["A3_baskets", "C11_multi_item_lines", "C12_multi_row_receipts"])
def test_the_ledger_is_read_once(spark, name):
    """Apart from the runtime filters that Spark may add by itself, and from
    tables that a miner of an earlier test has left cached."""
    spark.catalog.clearCache()
    import __spark_entry__ as entry
    from conftest import SF001
    key = "spark.sql.optimizer.runtime.bloomFilter.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        plan = entry.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    scans = [line[:120] for line in plan.splitlines() if "FileScan parquet [l_" in line or "Join" in line or "Subquery" in line]
    assert sum("FileScan parquet [l_" in line for line in scans) == 1, "\n".join(scans)
