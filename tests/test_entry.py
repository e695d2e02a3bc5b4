import os

import pytest

import __spark_entry__ as entry
from ardoise.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query_and_names_are_unique():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and all(map(callable, queries.values()))
    assert sum(len(m.QUERIES) for m in registry.modules()) == len({n for m in registry.modules() for n in m.QUERIES})


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
@pytest.mark.parametrize("name", ["argent_drapeaux", "or_signaux", "concentration_titulaires", "detection_seuils", "liens_niveaux", "recherche_bm25", "p5_found"])
def test_queries_equal_their_oracles_on_the_smallest_tables(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SMALL}/{f}')")
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    tidy = lambda v: round(v, 5) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v
    got = sorted((repr([tidy(r[c]) for c in columns]) for r in df.collect()))
    want = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(repr([tidy(v) for v in r]) for r in want)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
