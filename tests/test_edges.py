import os

import pytest

from ardoise.plans import heavy_keys, spikes

SMALL = "/root/testdata/sf0.001"
TABLES = "marches signaux recherche statistiques_familles avis verdicts_rapprochement documents items_evaluation contenants".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")


def variant(spark, folder, kind):
    """The data folder with every table empty, or with rows of nulls only."""
    for t in TABLES:
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        if kind == "empty":
            df = df.limit(0)
        else:
            df = spark.createDataFrame([(None,) * len(df.columns)] * 3, ", ".join(f"`{c}` {k}" for c, k in df.dtypes))
        df.write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("kind", ["empty", "null"])
def test_nothing_is_found_in_nothing(spark, tmp_path, kind):
    d = variant(spark, tmp_path, kind)
    assert heavy_keys.p5_found(spark, d).count() == 0
    assert heavy_keys.p5_par_cle(spark, d).count() == (0 if kind == "empty" else 2)
    assert spikes.p2_found(spark, d).count() == 0
