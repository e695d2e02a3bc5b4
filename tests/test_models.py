import numpy as np
import pytest

from ardoise.operators import evaluation as E
from ardoise.operators import models as M

V = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(4)
    x = [(i, float(p), float(q)) for i, (p, q) in enumerate(r.normal(5, 1, (600, 2)))]
    x[7], x[8] = (7, 40.0, -30.0), (8, None, 5.0)
    return spark.createDataFrame(x, "id long, a double, b double")


@pytest.mark.parametrize("score", [M.kmeans_scores, M.reconstruction_scores, M.ellipse_scores, M.local_outlier_scores])
def test_every_score_puts_the_outlier_far_up_and_scores_every_row(rows, score):
    kw = {"centres": 3} if score is M.kmeans_scores else {"axes": 1} if score is M.reconstruction_scores else {}
    got = {r.id: r.score for r in score(M.scaled(rows, V, True), V, **kw).collect()}
    assert len(got) == 600 and all(v is not None for v in got.values())
    if score is not M.kmeans_scores and score is not M.reconstruction_scores:
        assert max(got, key=got.get) == 7


def test_scaling(rows):
    x = M.scaled(rows, V, False).toPandas()
    assert x["a"].mean() == pytest.approx(0, abs=1e-9) and x["b"].std(ddof=0) == pytest.approx(1)
    y = M.scaled(rows, V, True).toPandas()
    assert y["a"].median() == pytest.approx(0, abs=1e-2)


def test_local_outliers_equal_brute_force():
    r = np.random.default_rng(1)
    known, rows = r.normal(size=(60, 3)), r.normal(size=(25, 3))
    model = M.LocalOutliers(known, 5)
    dist = np.linalg.norm(known[:, None] - known[None], axis=2)
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(dist, axis=1)[:, :5]
    reach = np.sort(dist, axis=1)[:, 4]
    dens = np.array([1 / np.mean([max(reach[j], dist[i, j]) for j in near[i]]) for i in range(60)])
    for x, got in zip(rows, model.score(rows, block=7)):
        d = np.linalg.norm(known - x, axis=1)
        n = np.argsort(d)[:5]
        own = 1 / np.mean([max(reach[j], d[j]) for j in n])
        assert got == pytest.approx(dens[n].mean() / own)


def test_one_class_machine_is_a_plane_over_all_rows(rows):
    got = {r.id: r.score for r in M.one_class_scores(M.scaled(rows, V, True), V).collect()}
    assert len(got) == 600 and len(set(got.values())) > 500


def test_empty_table(rows):
    none = rows.limit(0)
    for f in (M.kmeans_scores, M.reconstruction_scores, M.ellipse_scores, M.one_class_scores, M.local_outlier_scores):
        assert f(M.scaled(none, V, True), V).count() == 0


def test_weighted_accuracy_uses_real_sizes_and_says_none():
    labels, sizes = {"a": [True, False], "b": [True, True]}, {"a": 30, "b": 10, "c": 5}
    assert E.weighted_accuracy(labels, sizes, ["a", "b"]) == pytest.approx((30 * 0.5 + 10) / 40)
    assert E.weighted_accuracy(labels, sizes, ["a", "c"]) is None and E.weighted_accuracy(labels, {}, ["a"]) is None
    low, high, flat = E.stratified_bootstrap({"a": [True] * 30 + [False] * 30}, {"a": 1.0}, 20_000, 3)
    assert (low, high) == (pytest.approx(0.375, abs=0.02), pytest.approx(0.625, abs=0.02)) and not flat


def test_draws_with_replacement_follow_the_weights(spark, tmp_path):
    from ardoise.plans.evaluation import tirage_pondere

    rows = [(f"{1:014d}",)] * 90 + [(f"{2:014d}",)] * 10 + [("kurz",)] * 50
    spark.createDataFrame(rows, "titulaire_siret string").write.parquet(f"{tmp_path}/marches.parquet")
    got = [r.titulaire_siret for r in tirage_pondere(spark, str(tmp_path), 400).collect()]
    assert len(got) == 400 and 0.8 < got.count(f"{1:014d}") / 400 < 0.97
