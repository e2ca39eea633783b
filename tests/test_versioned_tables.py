"""Replacement by versions and a manifest."""

import threading

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.sources import io as IO

SCHEMA = "platform string, v int"


@pytest.fixture
def table(spark, tmp_path):
    start = spark.createDataFrame([("Shopee", 1), ("Lazada", 2)], SCHEMA)
    return IO.replace_table(start, str(tmp_path / "t")), start.schema


def test_a_load_that_fails_midway_leaves_the_old_rows(spark, table):
    t, schema = table
    bad = (spark.range(1000).repartition(8).select(
        F.lit("Shopee").alias("platform"),
        F.when(F.col("id") == 999, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("id").cast("int")).alias("v")))
    with pytest.raises(Exception, match="lost"):
        IO.replace_partition(bad, t.path, "Shopee")
    assert rows(t.read(schema)) == [("Lazada", 2), ("Shopee", 1)]
    with pytest.raises(Exception, match="lost"):
        IO.replace_table(bad, t.path)
    assert rows(t.read(schema)) == [("Lazada", 2), ("Shopee", 1)]


def test_a_reader_keeps_what_it_has_resolved(spark, table):
    t, schema = table
    before = t.read(schema)
    IO.replace_partition(spark.createDataFrame([("Shopee", 7)], SCHEMA), t.path, "Shopee")
    assert rows(before) == [("Lazada", 2), ("Shopee", 1)]
    assert rows(t.read(schema)) == [("Lazada", 2), ("Shopee", 7)]
    assert rows(t.read(schema, "Shopee")) == [("Shopee", 7)]
    assert t.drop_old_versions() == 0  # Lazada's rows are still the first version's
    IO.replace_table(spark.createDataFrame([("Shopee", 8)], SCHEMA), t.path)
    assert t.drop_old_versions() == 2 and rows(t.read(schema)) == [("Shopee", 8)]


def test_writers_at_the_same_time_both_count(spark, table):
    t, schema = table
    loads = [(f"p{i}", i) for i in range(6)]
    threads = [threading.Thread(target=lambda p=p, v=v: IO.replace_partition(
        spark.createDataFrame([(p, v)], SCHEMA), t.path, p)) for p, v in loads]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert rows(t.read(schema)) == sorted([("Lazada", 2), ("Shopee", 1), *loads])


def test_a_writer_that_always_comes_second_is_told(spark, table, monkeypatch):
    t, _ = table
    monkeypatch.setattr(t, "_numbers", lambda: [])
    with pytest.raises(IO.TableConflict):
        t.commit({"platform=x": {"version": "v0"}}, tries=3)


def test_unpartitioned_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    t = IO.replace_table(df, str(tmp_path / "whole"), partition_col=None)
    assert rows(t.read(df.schema)) == [(1,), (2,)]
    t.replace(df.where("v > 1"))
    assert rows(t.read(df.schema)) == [(2,)]
    none = IO.VersionedTable(spark, str(tmp_path / "never"))
    assert none.read(df.schema).count() == 0 and none.manifest() == {}
