import os

import pytest
from pyspark.sql import functions as F

from ardoise.llm import plans

SMALL = "/root/testdata/sf0.001"
TABLES = "marches recherche statistiques_familles avis verdicts_rapprochement documents items_evaluation contenants".split()
CLASHING = "contrat fournisseur part n lo hi mots cle bloc niveau entite champ nom valeur groupe rang _c total id_groupe texte tokens ligne debut fin poids sonde rank before".split()
QUERIES = {n: f for m in plans.modules() for n, f in m.QUERIES.items() if n.endswith("_found") or n == "p7_contenants"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")


@pytest.mark.parametrize("kind", ["empty", "null"])
def test_nothing_is_found_in_nothing(spark, tmp_path, kind):
    for t in TABLES:
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        df = df.limit(0) if kind == "empty" else spark.createDataFrame([(None,) * len(df.columns)] * 3, ", ".join(f"`{c}` {k}" for c, k in df.dtypes))
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    assert {n: f(spark, str(tmp_path)).count() for n, f in QUERIES.items()} == dict.fromkeys(QUERIES, 0)


@pytest.mark.parametrize("name", ["p4_found", "p6_found", "p8_found"])
def test_extra_columns_with_names_of_ours_change_nothing(spark, tmp_path, name):
    for t in TABLES:
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns}).write.parquet(f"{tmp_path}/{t}.parquet")
    rows = [sorted(map(str, QUERIES[name](spark, d).collect())) for d in (str(tmp_path), SMALL)]
    assert rows[0] == rows[1]
