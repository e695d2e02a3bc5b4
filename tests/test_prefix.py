import random

import pytest
from pyspark.sql import functions as F

from ardoise.operators.prefix import ranked


@pytest.mark.parametrize("descending", [False, True])
def test_equals_one_sorted_pass(spark, descending):
    r = random.Random(3)
    rows = [(i, r.choice([1, 5, 5, 9, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    order = [F.desc_nulls_last("v"), F.desc("id")] if descending else [F.asc_nulls_first("v"), F.asc("id")]
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]), reverse=descending)
    got = sorted(ranked(df, order, "v").collect(), key=lambda x: x.rang)
    assert [(x.id, x.v) for x in got] == want and [x.rang for x in got] == list(range(1, 501))
    total = 0
    for x in got:
        total += x.v or 0
        assert x.cumul == total


def test_empty(spark):
    assert ranked(spark.createDataFrame([], "id long"), [F.col("id")]).count() == 0
