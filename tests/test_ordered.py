"""Segmented prefix sums and paged tables."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.ordered import PagedTable, grouped_rank
from ledgerlens.operators import evaluate as EV


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_grouped_rank_equals_a_window(spark, partitions):
    """A group with most rows spans many partitions, others share one."""
    data = [("hot" if i % 3 else f"g{i % 7}" if i % 5 else None, i % 11, i, i % 2) for i in range(700)]
    df = spark.createDataFrame(data, "g string, a int, id int, x int")
    got = grouped_rank(df, ["g"], [F.col("a").desc(), F.col("id")], running={"s": F.col("x")}, partitions=partitions)
    assert got.columns == ["g", "a", "id", "x", "k", "s"]
    want = df.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY a DESC, id) AS k",
                         "CAST(sum(x) OVER (PARTITION BY g ORDER BY a DESC, id) AS DOUBLE) AS s")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan or partitions == 1


def test_grouped_rank_edges(spark):
    empty = spark.createDataFrame([], "g string, h int, a int")
    assert grouped_rank(empty, ["g", "h"], [F.col("a")]).count() == 0
    two = spark.createDataFrame([("x", 1, 5), ("x", 2, 4), ("x", 1, 3), (None, None, 1), (None, None, 2)], empty.schema)
    got = grouped_rank(two, ["g", "h"], [F.col("a")], rank_col="n")
    assert {(r.g, r.h, r.a): r.n for r in got.collect()} == {
        ("x", 1, 3): 1, ("x", 1, 5): 2, ("x", 2, 4): 1, (None, None, 1): 1, (None, None, 2): 2}


def test_one_curve_per_group(spark):
    rows = [(p, f"r{i}", 1.0 / (i + 1), v) for p, labels in (("A", [1, 0, 1]), ("B", [0, 1]), ("C", [None]))
            for i, v in enumerate(labels)]
    df = spark.createDataFrame(rows, "platform string, rule_key string, support double, validity int")
    got = EV.precision_curves(df, ["platform"])
    assert sorted((r.platform, r.k, r.valid_at_k, round(r.precision, 6)) for r in got.collect()) == [
        ("A", 1, 1, 1.0), ("A", 2, 1, 0.5), ("A", 3, 2, 0.666667), ("B", 1, 0, 0.0), ("B", 2, 1, 0.5)]


@pytest.mark.parametrize("n", [1, 10, 95, 1000])
def test_pages_are_those_of_the_sorted_table(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("x"), F.col("id").alias("id"))
    table = PagedTable(df, [F.col("x").desc(), F.col("id")], 10, partitions=7)
    want = sorted(((r.x, r.id) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    assert (table.total_rows, table.total_pages) == (n, -(-n // 10))
    for page in {1, table.total_pages // 2 or 1, table.total_pages}:
        got = sorted((r.row_no, r.page_no, r.x, r.id) for r in table.pages(page).collect())
        assert got == [(i + 1, page, *want[i]) for i in range((page - 1) * 10, min(n, page * 10))]
    assert table.pages(table.total_pages + 1).count() == 0


def test_a_late_page_sorts_nothing_and_reads_one_partition(spark):
    table = PagedTable(spark.range(5000).toDF("id"), [F.col("id")], 10, partitions=8)
    page = table.pages(table.total_pages)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "TakeOrdered" not in plan and "Exchange" not in plan
    assert "PartitionFilters: [_pid" in plan or "_pid IN" in plan or "_pid#" in plan.split("PartitionFilters")[1]
    assert sorted(r.id for r in page.collect()) == list(range(4990, 5000))
    empty = PagedTable(spark.createDataFrame([], "id long"), [F.col("id")], 10)
    assert (empty.total_pages, empty.pages(1).count()) == (0, 0)
