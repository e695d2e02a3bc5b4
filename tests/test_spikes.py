import numpy as np
import pytest
from pyspark.sql import functions as F

from ardoise.operators import spikes as S

SCHEMA = "champ string, id long, source string, groupe string, lot long, valeur double, niveau double, attribution long, hors boolean, indice boolean"


def series(seed=1, n=900, source="s", start=0):
    r = np.random.default_rng(seed)
    return [["montant", start + i, source, f"g{i % 3}", 0, float(v), float(v), start + i, False, False] for i, v in enumerate(r.normal(5 + 2 * (source == "t"), 0.5, n))]


def flags(spark, rows):
    df = spark.createDataFrame([tuple(x) for x in rows], SCHEMA)
    return {(r.champ, r.id): r.etat for r in S.flag_readings(df, F.lit(False)).collect()}


def test_spikes_stuck_values_and_bounds_are_found(spark):
    rows = series() + series(2, source="t", start=5000)
    rows[100][5] = rows[100][6] = 11.0
    rows[950][5] = rows[950][6] = 1.0
    for i in range(300, 330, 2):
        rows[i][5] = rows[i][6] = 5.25
    rows[500][5], rows[500][6], rows[500][8] = -3.0, None, True
    found = flags(spark, rows)
    assert found[("montant", rows[100][1])] == "pic" and found[("montant", rows[950][1])] == "pic"
    assert found[("montant", rows[500][1])] == "hors_bornes"
    assert {k[1] for k, v in found.items() if v == "fige"} == {rows[i][1] for i in range(300, 330, 2)}
    assert len(found) <= 20


def test_repeats_within_one_award_are_not_stuck(spark):
    rows = series()
    for i in range(300, 330, 2):
        rows[i][5] = rows[i][6] = 5.25
        rows[i][7] = 77
    assert "fige" not in flags(spark, rows).values()


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rows = series(3, 700)
    for i in range(200, 260, 3):
        rows[i][5] = rows[i][6] = 4.75
    rows[650][5] = rows[650][6] = 12.0
    whole = flags(spark, rows)
    monkeypatch.setattr(S, "BLOCK", 64)
    assert flags(spark, rows) == whole


def test_prefix_products_equal_a_loop():
    r = np.random.default_rng(0)
    m = r.random((37, 4, 4))
    got, p = S._prefix(m), np.eye(4)
    for i in range(37):
        p = p @ m[i]
        assert np.allclose(got[i], p / p.max())


@pytest.mark.parametrize("rows", [[], [["montant", 1, None, None, None, 5.0, 5.0, 1, False, False]]])
def test_empty_and_null_keys(spark, rows):
    assert flags(spark, rows) == {}


def test_messages_over_a_tree_equal_one_run(spark, monkeypatch):
    r = np.random.default_rng(5)
    start = [0.99, 0.005, 0.003, 0.002]
    rows = [("montant", s, None if s == "b" else 1, k, r.random(16).tolist(), start) for s in ("a", "b") for k in range(13)]
    df = spark.createDataFrame(rows, S.MATRICES)
    key = lambda x: {(m.source, m.bloc): (np.array(m.avant), np.array(m.apres)) for m in x.collect()}
    whole = key(S.entering_messages(df, 13))
    monkeypatch.setattr(S, "FAN", 3)
    tree = key(S.entering_messages(df, 13))
    assert whole.keys() == tree.keys() and len(tree) == 26
    for k, (before, after) in whole.items():
        assert np.allclose(before, tree[k][0]) and np.allclose(after / after.sum(), tree[k][1] / tree[k][1].sum())


def test_stuck_needs_a_stretch_not_just_repeats(spark):
    rows = series(7, 900)
    for i in range(5, 900, 60):  # fifteen times the same value, far apart
        rows[i][5] = rows[i][6] = 5.125
    assert "fige" not in flags(spark, rows).values()
    for i in range(400, 410):
        rows[i][5] = rows[i][6] = 4.875
    assert {k[1] for k, v in flags(spark, rows).items() if v == "fige"} == set(range(400, 410))
