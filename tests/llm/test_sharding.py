"""Feistel sharding against a Python version of the permutation."""

import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import sharding
from ledgerlens.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def spark_xx(*values):
    """Spark's xxhash64 of (long, int, long) arguments, seed 42, unsigned."""
    h = 42
    for v, kind in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q" if kind == "long" else "<i", v), seed=h)
    return h


def permute(x, n, seed, rounds=sharding.ROUNDS):
    bits = max(2, (n - 1).bit_length() or 1)
    high, low = bits // 2, bits - bits // 2
    while True:
        for i in range(rounds):
            if i % 2 == 0:
                h = spark_xx((x & ((1 << low) - 1), "long"), (i, "int"), (seed, "long"))
                x ^= (h & ((1 << high) - 1)) << low
            else:
                h = spark_xx((x >> low, "long"), (i, "int"), (seed, "long"))
                x ^= h & ((1 << low) - 1)
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_permutation_and_inverse(spark, n):
    df = spark.range(n).select("id", F.lit(n).cast("long").alias("n"))
    df = df.withColumn("p", sharding.permuted("id", "n", 7)).withColumn("back", sharding.row_at("p", "n", 7))
    got = {r.id: (r.p, r.back) for r in df.collect()}
    assert {k: v[0] for k, v in got.items()} == {i: permute(i, n, 7) for i in range(n)}
    assert all(back == i for i, (_, back) in got.items())
    assert sorted(p for p, _ in got.values()) == list(range(n))


def test_query_on_whole_table(spark):
    rows = QUERIES["op2_feistel_shards"](spark, SF01).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    n = len(rows)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert sorted(r.row_number for r in rows) == list(range(n))
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        p = permute(r.row_number, n, 2)
        assert (r.shard, r.slot) == (p % 16, p // 16)
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_same_shuffle_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    a = sharding.feistel_shards(docs, 8, 1).select("doc_id", "shard", "slot").collect()
    b = sharding.feistel_shards(docs.repartition(13), 8, 1).select("doc_id", "shard", "slot").collect()
    assert sorted(a) == sorted(b)


def test_edges(spark):
    schema = "doc_id long, text string, shard string, _bucket int, n_rows int"
    empty = spark.createDataFrame([], schema)
    assert sharding.feistel_shards(empty, 4).count() == 0
    one = sharding.feistel_shards(spark.createDataFrame([(None, None, "x", 1, 1)], schema), 4).collect()
    assert [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in one] == [(None, 1, 0, 0, 0)]
    same = spark.createDataFrame([(5, "x" * 100_000, None, None, None)] * 9 + [(6, "", "", 0, 0)], schema)
    rows = sharding.feistel_shards(same, 4).collect()
    assert sorted(r.shard + 4 * r.slot for r in rows) == list(range(10))
    with pytest.raises(ValueError):
        sharding.feistel_shards(same, 0)
