from collections import Counter

from pyspark.sql import functions as F

from ardoise.operators.heavy_keys import heavy_keys, tree_aggregate


def rows():
    hot = [("hot", float(i)) for i in range(600)]
    return hot + [(None, 1.0)] * 30 + [(f"k{i % 90}", None if i % 7 == 0 else -1.0 * i) for i in range(900)]


def test_tree_equals_plain_grouping(spark):
    df = spark.createDataFrame(rows(), "cle string, v double").repartition(7)
    values = {"n": ("count", F.lit(1)), "avec": ("count", F.col("v")), "somme": ("sum", F.col("v")), "bas": ("min", F.col("v")), "haut": ("max", F.col("v"))}
    for fan_in, chunk in ((2, 16), (3, 1), (64, 1 << 20)):
        got = {r.cle: tuple(r)[1:] for r in tree_aggregate(df, F.col("cle"), values, chunk, fan_in).collect()}
        want = {r.cle: tuple(r)[1:] for r in df.groupBy("cle").agg(F.count(F.lit(1)), F.count("v"), F.sum("v"), F.min("v"), F.max("v")).collect()}
        assert got == want


def test_heavy_keys_count_null_rows_in_the_total(spark):
    df = spark.createDataFrame(rows(), "cle string, v double")
    counts = Counter(k for k, _ in rows())
    total = sum(counts.values())
    for share in (0.3, 0.01):
        want = {k for k, n in counts.items() if k is not None and n >= share * total}
        assert {r.cle for r in heavy_keys(df, F.col("cle"), share, 8, 2).collect()} == want


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "_cle string, cle string, n long")
    assert heavy_keys(df, F.col("cle"), 0.03).count() == 0
    df = spark.createDataFrame([("a", "x", 5)] * 4, "_cle string, cle string, n long")
    assert [tuple(r) for r in heavy_keys(df, F.col("cle"), 0.03).collect()] == [("x", 4, 4)]
