import numpy as np
import pytest

from ardoise.llm import percentiles as P

PS = {"q1": 0.25, "med": 0.5, "q3": 0.75, "p99": 0.99}


def frame(spark):
    r = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in np.round(r.lognormal(8, 2, 4000), 2)] + [("ties", 7.0)] * 300 + [("neg", float(v)) for v in r.normal(0, 50, 501)] + [(None, 3.0), (None, 9.0), ("nan", float("nan")), ("null", None), ("one", 1e300)]
    return rows, spark.createDataFrame(rows, "part string, lo double")


@pytest.mark.parametrize(("leaf", "fan"), [(4096, 256), (8, 4), (1, 2)])
def test_equals_numpy(spark, leaf, fan):
    rows, df = frame(spark)
    got = {r.part: r for r in P.quantiles(df, ["part"], "lo", PS, leaf, fan).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        for name, p in PS.items():
            assert got[g][name] == pytest.approx(np.percentile(vs, 100 * p), rel=1e-12)


def test_merged_summaries_bound_the_union(spark):
    rows, df = frame(spark)
    df = df.withColumnRenamed("part", "g")
    halves = [P.summarise(x, ["g"], "lo") for x in df.randomSplit([0.5, 0.5], 3)]
    merged = P.merge(halves[0].unionByName(halves[1]), ["g"])
    exact = {r.g: r for r in P.quantiles(df, ["g"], "lo", PS).collect()}
    for r in P.bounds(merged, ["g"], PS).collect():
        for name in PS:
            assert r[f"{name}_bas"] <= exact[r.g][name] <= r[f"{name}_haut"]
        if r.g == "hot":
            assert r.med_haut / r.med_bas < 1.02


def test_empty(spark):
    assert P.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", PS).count() == 0
