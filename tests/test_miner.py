"""M2 (F21-F24, F26-F28, F30-F33): itemsets level by level."""
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.operators import rules as R


@pytest.mark.parametrize("broadcast", [500_000, 0])
@pytest.mark.parametrize("partitions", [None, 3])
def test_levels_give_the_sets_of_fp_growth(spark, monkeypatch, broadcast, partitions):
    monkeypatch.setattr(R, "BROADCAST_SETS", broadcast)
    rnd = random.Random(5)
    data = [(rnd.sample("abcdefghij", rnd.choice([0, 1, 3, 6, 8])),) for _ in range(60)] + [(list("abcde"),)] * 9
    bk = spark.createDataFrame(data, "items array<string>")
    got = rows(R.frequent_itemsets(bk, 0.13, num_partitions=partitions))
    want = R._fit(bk, 0.13, 1.0).freqItemsets.select(F.array_sort("items"), "freq")
    assert got == rows(want) and max(len(r[0]) for r in got) >= 5


def test_a_repeated_item_is_an_error_and_no_basket_is_no_set(spark):
    with pytest.raises(ValueError, match="unique"):
        R.frequent_itemsets(spark.createDataFrame([(["a", "a"],)], "items array<string>"), 0.1)
    assert rows(R.frequent_itemsets(spark.createDataFrame([], "items array<string>"), 0.1)) == []
