"""Similarity of texts with many copies (F1-F8, F11-F13): texts are compared,
documents appear in the output only."""
import datetime
import math

import pytest
from conftest import SF01, rows
from pyspark.sql import functions as F
from test_operators import _brute_tfidf_cosine

from ledgerlens.operators import baskets as B
from ledgerlens.operators import bundles as BU
from ledgerlens.operators import joins as J
from ledgerlens.operators import segment as G
from ledgerlens.operators import similarity as SIM
from ledgerlens.plans import queries as Q

TEXTS = ["bor kayu", "bor besi the", "gergaji kayu the", "mata bor kayu the and", "x", "baut besi and"]


def _sides(spark):
    a = [(i, TEXTS[i % 6]) for i in range(40)]
    b = [(100 + j, TEXTS[(j * j) % 5] + (" selang" if j % 7 == 0 else "")) for j in range(30)]
    return a, b, *(spark.createDataFrame(x, "id long, text string") for x in (a, b))


@pytest.mark.parametrize("small", [200_000, -1])
@pytest.mark.parametrize("known", [1_000_000, 1])
def test_copies_get_all_their_pairs(spark, monkeypatch, small, known):
    """By broadcast and by index, with rare tokens apart, members in several
    rows and these dealt out anew."""
    for name, value in (("SMALL_POSTINGS", small), ("KNOWN_TOKENS", known), ("CHUNK", 2), ("MANY", 2)):
        monkeypatch.setattr(SIM, name, value)
    a, b, da, db = _sides(spark)
    found = SIM.text_pairs(da, db, 0.2)
    got = {(r.id_1, r.id_2): r.score for r in found.expand().collect()}
    want = {k: v for k, v in _brute_tfidf_cosine(a, b).items() if v > 0.2}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert 0 < found.pairs.count() <= 6 * 10 < len(want)


def test_rows_of_one_id_are_one_document(spark):
    a = spark.createDataFrame([(1, "bor kayu"), (1, "besi"), (2, None), (3, "kayu bor besi")], "id long, text string")
    b = spark.createDataFrame([(10, "besi kayu bor")], "id long, text string")
    assert rows(SIM.cosine_pairs(a, b, 0.5).select("id_1", "id_2", F.round("score", 9))) == [(1, 10, 1.0), (3, 10, 1.0)]


@pytest.mark.parametrize("best", [False, True])
def test_partners_come_from_texts(spark, best):
    _, _, da, db = _sides(spark)
    dead, product = (d.select(F.col("id").alias("id_barang")) for d in (db, da.union(db)))
    texts = SIM.purge_identical(SIM.text_pairs(da, db, 0.2), dead, product)
    plain = SIM.purge_identical(SIM.cosine_pairs(da, db, 0.2), dead, product)
    assert rows(texts[1]) == rows(plain[1]) and 0 < texts[1].count() < dead.count()
    assert rows(texts[2]) == rows(plain[2])
    named = plain[0].select(F.col("id_1").alias("id_barang_1"), F.col("id_2").alias("id_barang_2"), "score")
    got = rows(BU.first_partner(texts[0], best), "id_barang_1", "replacement")
    assert got and got == rows(BU.first_partner(named, best), "id_barang_1", "replacement")


def test_the_replacement_makes_no_pairs_of_items(spark):
    """The pairs that M13 keeps are of texts: items of one name add none."""
    name = F.element_at(F.split("text", " "), 1)
    a, b = Q._detail_sides(spark, SF01)
    a, b = (x.withColumn("text", name) for x in (a, b))
    found = SIM.text_pairs(a, b, 0.3)
    n_a, n_b = (x.select("text").distinct().count() for x in (a, b))
    assert 0 < found.pairs.count() <= n_a * n_b < found.expand().count()


def test_ranks_of_copies_are_those_of_all_pairs(spark, monkeypatch):
    """Copies of several texts tie, and their ids interleave."""
    monkeypatch.setattr(J, "RANK_CHUNK", 7)
    monkeypatch.setattr(J, "PARTNER_CHUNK", 2)
    _, _, da, db = _sides(spark)
    found = SIM.text_pairs(da, db, 0.2)
    score = F.round("score", 1)
    got = rows(J.rank_pairs(found, score=score), "rank", "id_1", "id_2")
    pairs = sorted(((-r.s, r.id_1, r.id_2) for r in found.expand().select("id_1", "id_2", score.alias("s")).collect()))
    assert got == [(i, a, b) for i, (_, a, b) in enumerate(pairs, 1)]
    assert got == rows(J.rank_pairs(found.expand(), score=score), "rank", "id_1", "id_2")


def test_ranked_pairs_are_not_shuffled(spark):
    """r04 F1: documents and their partners are dealt out before they meet, and
    nothing that grows with the product of both is dealt out after."""
    _, _, da, db = _sides(spark)
    plan = J.rank_pairs(SIM.text_pairs(da, db, 0.2))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Join") < plan.index("RepartitionByExpression"), plan


def test_items_and_their_statistics_need_one_shuffle_by_receipt(spark):
    """A4, A9, A1 (F18-F20, F29): receipts and (product, date) are dealt out over
    all shuffle partitions, however small or compressible the rows are."""
    lines = spark.createDataFrame(
        [("N1", "A"), ("N1", "B"), ("N1", "B"), ("N2", "C"), ("N2", None), (None, "D"), (None, "E"), ("N3", "B"), ("N3", "A")],
        "kode_nota string, deskripsi_brg string").selectExpr("*", "date'2020-01-01' AS tanggal", "1 AS jml")
    assert rows(B.sold_together(lines)) == [("A",), ("B",)]
    assert rows(B.product_pairing_stats(lines)) == [
        ("A", 1, 2, 2 * 100 / 3), ("B", 1, 3, 100.0), ("C", 1, 1, 100 / 3)]
    n = spark.conf.get("spark.sql.shuffle.partitions")
    for frame, keys in ((B.sold_together(lines), "kode_nota"), (G.daily_rollup(lines), "deskripsi_brg")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x]
        assert len(dealt) == 1 and keys in dealt[0] and f", {n})" in dealt[0], plan


@pytest.mark.parametrize("distinct", [False, True])
def test_classes_hold_every_link_once(spark, distinct):
    """a result between classes grows with texts and documents, and
    its members make all pairs of documents again."""
    a, b, da, db = _sides(spark)
    if distinct:  # no two documents of a side with one text
        da, db = (d.where(F.col("id").isin(ids)) for d, ids in ((da, list(range(6))), (db, [100, 101])))
        a, b = ([tuple(r) for r in d.collect()] for d in (da, db))
    found = SIM.text_pairs(da, db, 0.2)
    got = SIM.class_pairs(found)
    assert got.columns[0:3] == ["id_1", "id_2", "score"] and set(got.columns[3:]) == {"kind", "id"}
    of = {k: {} for k in ("member_1", "member_2")}
    for r in got.where("kind <> 'pair'").collect():
        assert r.id not in of[r.kind] and r.score is None
        of[r.kind][r.id] = r.id_1 if r.kind == "member_1" else r.id_2
    for side, data in (("member_1", a), ("member_2", b)):
        first = {}
        for i, text in sorted(data):
            first.setdefault(text, i)
        assert of[side] == {i: first[text] for i, text in data}
    pairs = {(r.id_1, r.id_2): r.score for r in got.where("kind = 'pair'").collect()}
    assert len(pairs) <= 6 * 10
    want = {k: v for k, v in _brute_tfidf_cosine(a, b).items() if v > 0.2}
    again = {(i, j): pairs[x, y] for i, x in of["member_1"].items() for j, y in of["member_2"].items() if (x, y) in pairs}
    assert set(again) == set(want) and all(math.isclose(again[k], want[k], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("distinct", [False, True])
def test_a_purge_takes_the_members_too(spark, distinct):
    _, _, da, db = _sides(spark)
    if distinct:
        da, db = da.where("id < 6"), db.where("id in (100, 101)")
    dead, product = (d.select(F.col("id").alias("id_barang")) for d in (db, da.union(db)))
    found, left, _ = SIM.purge_identical(SIM.text_pairs(da, db, 0.2), dead, product)
    members = rows(SIM.class_pairs(found).where("kind = 'member_2'"), "id")
    assert members == rows(left) and len(members) < dead.count()
    assert rows(found.documents.where("side = 'B'"), "id") == members



NAMES = dict(enumerate(["bor kayu", "bor kayu", "gergaji kayu", "baut", "bor kayu besi", "bor kayu besi", "gergaji kayu"], 1))


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Parts with NAMES: 1 to 4 sold together, 5 to 7 without a sale; 1 and 2
    have one name, so have 5 and 6, and 7 is the same as 3."""
    at, day = tmp_path_factory.mktemp("shop"), datetime.datetime(1998, 8, 1)
    for name, schema, data in (
            ("part", "p_partkey long, p_name string, p_brand string, p_type string", [(i, x, "merek", "alat") for i, x in NAMES.items()]),
            ("orders", "o_orderkey long, o_custkey long, o_orderdate timestamp", [(1, 1, day)]),
            ("lineitem", "l_orderkey long, l_partkey long, l_quantity double", [(1, i, 1.0) for i in range(1, 5)])):
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def _shop_pairs(more=""):
    found = _brute_tfidf_cosine([(i, NAMES[i] + more) for i in range(1, 5)], [(i, NAMES[i] + more) for i in range(5, 8)])
    return sorted((*k, round(v, 6)) for k, v in found.items())


def test_similar_products_are_pairs_of_items(spark, shop):
    """r04 F2: copies of a name are items of their own, as in the reference."""
    got = Q.QUERIES["T3_cosine_products"](spark, shop)
    assert got.columns == ["id_barang_1", "id_barang_2", "score"]
    assert rows(got) == [x for x in _shop_pairs() if x[2] > 0.3]
    assert {(1, 5), (1, 6), (2, 5), (2, 6)} < {x[:2] for x in rows(got)}


def test_threshold_sets_hold_pairs_of_items(spark, shop):
    """r04 F3: every set has the pairs of all copies, as the reference's sheets."""
    got = Q.QUERIES["T5_threshold_sets"](spark, shop)
    assert got.columns == ["label", "id_1", "id_2", "score"]
    assert rows(got) == sorted((f"Filtered (>{t})", *x) for t in (0.1, 0.3, 0.5) for x in _shop_pairs() if x[2] > t)
    assert {x[1:3] for x in rows(got)} > {(1, 5), (1, 6), (2, 5), (2, 6)}


def test_a_purge_leaves_pairs_of_items(spark, shop):
    """r04 F4: 7 is the same as 3 and goes; the pairs of 5 and 6 with every copy stay."""
    got = Q.QUERIES["T6_purge_identical"](spark, shop)
    assert got.columns == ["id_barang_1", "id_barang_2", "score"]
    assert rows(got) == [x for x in _shop_pairs(" merek alat") if x[2] > 0.3 and x[1] != 7]
    assert {x[:2] for x in rows(got)} > {(1, 5), (1, 6), (2, 5), (2, 6)}
