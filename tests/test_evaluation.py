import random

import numpy as np
import pytest

from ardoise.operators import evaluation as E
from ardoise.operators import linking as L


def test_exact_interval_known_values():
    assert E.clopper_pearson(0, 0) == (0.0, 100.0)
    lo, hi = E.clopper_pearson(0, 10)
    assert lo == 0 and hi == pytest.approx(30.85, abs=0.01)
    lo, hi = E.clopper_pearson(8, 10)
    assert (lo, hi) == (pytest.approx(44.39, abs=0.01), pytest.approx(97.48, abs=0.01))
    for k in range(21):
        lo, hi = E.clopper_pearson(k, 20)
        assert lo <= 5 * k <= hi


def test_bootstrap_is_reproducible_and_says_when_degenerate():
    x = {"a": [True, False, True], "b": [True] * 4}
    w = {"a": 3.0, "b": 4.0}
    assert E.stratified_bootstrap(x, w, 200) == E.stratified_bootstrap(x, w, 200) and not E.stratified_bootstrap(x, w, 200)[2]
    assert E.stratified_bootstrap({"b": [True]}, {"b": 1.0}, 50) == (1.0, 1.0, True)


def test_isolation_forest_isolates_outliers():
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    s = E.IsolationForest().fit(x).score(x)
    assert s.argmax() == 500 and 0 < s.min() and s.max() <= 1


def test_threshold_grid_and_budgets_equal_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.gauss(0, 2), r.random() < 0.2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, z double, juste boolean")
    for x in E.threshold_grid(df, [1.0, 3.0]).collect():
        ok = {"haut": lambda z: z > x.seuil, "bas": lambda z: z < -x.seuil, "deux": lambda z: abs(z) > x.seuil}[x.sens]
        assert (x.signales, x.justes) == (sum(ok(z) for _, z, _ in rows), sum(ok(z) and j for _, z, j in rows))
    top = sorted(rows, key=lambda t: (-t[1], t[0]))
    got = {x.budget: x.precision for x in E.precision_at(df, "z", [10, 1000]).collect()}
    assert got == {10: pytest.approx(10.0 * sum(j for _, _, j in top[:10]), abs=1e-4), 1000: 0.0}


def test_levels_of_linking(spark):
    import datetime as dt

    n = spark.createDataFrame([("a", "Objet tout autre", "Ville X", dt.date(2020, 1, 1), None), ("b", "achat de tables", "VILLE X", dt.date(2020, 1, 1), None), ("c", "rien", "Ville X", dt.date(2020, 1, 1), "Firme Y"), ("d", "achat", "Inconnue", dt.date(2020, 1, 1), None), ("e", "achat", "Ville X", dt.date(2010, 1, 1), None)], "idweb string, objet_boamp string, acheteur_nom string, date_parution date, titulaire_nom string")
    m = spark.createDataFrame([(1, "Achat de tables", "Ville X", dt.date(2020, 3, 1), "firme y")], "id long, objet string, acheteur_nom string, date_notification date, titulaire_nom string")
    x = L.levels(n, m)
    assert {r.idweb: r.niveau for r in x.collect()} == {"a": 2, "b": 3, "c": 4, "d": 0, "e": 1}
    assert [r.avis for r in L.funnel(x).orderBy("niveau").collect()] == [5, 4, 3, 2, 1]


def test_difflib(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string")
    assert [r.ratio for r in L.difflib_ratio(df, "a", "b").collect()] == [0.75, None]
