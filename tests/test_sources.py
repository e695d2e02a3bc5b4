import datetime as dt

import pytest
from pyspark.sql import functions as F

from ardoise.sources import collect as C
from ardoise.sources import publish as P
from ardoise.streaming import events as E


class Error(Exception):
    def __init__(self, status):
        self.status = status


def test_retry_policy():
    for status, calls in ((503, 4), (429, 4), (404, 1)):
        seen, waits = [], []

        def call(status=status, seen=seen):
            seen.append(1)
            raise Error(status)

        with pytest.raises(Error):
            C.with_retry(call, wait=waits.append)
        assert len(seen) == calls and waits == [1.0, 2.0, 4.0][: calls - 1]


def test_pages_stop_on_the_empty_page_and_at_the_most():
    data = [{"n": k} for k in range(25)]
    fetch = lambda offset, size: data[offset : offset + size]
    assert [r["n"] for r in C.pages(fetch, size=10)] == list(range(25)) and len(list(C.pages(fetch, 13, 10))) == 13


def test_files_lookup_words_latest_and_fingerprints(spark, tmp_path):
    (tmp_path / "a-01.csv").write_text("code,libelle,libelle_court\n01,Un,U\n")
    (tmp_path / "a-02.csv").write_text("code,libelle,libelle_court\n01,Un,U\n02,Deux,D\n")
    assert C.latest(spark, f"{tmp_path}/a-*.csv").endswith("a-02.csv")
    assert C.lookup(spark, C.latest(spark, f"{tmp_path}/a-*.csv")).count() == 2
    with pytest.raises(FileNotFoundError):
        C.latest(spark, f"{tmp_path}/b-*.csv")
    (tmp_path / "w.txt").write_text("# note\nle\n\nla \n")
    assert [r.mot for r in C.word_list(spark, str(tmp_path / "w.txt")).collect()] == ["le", "la"]
    f = C.fingerprints(spark, f"{tmp_path}/a-*.csv").cache()
    m = f.withColumn("sha256", F.when(F.col("fichier").endswith("01.csv"), "x").otherwise(F.col("sha256")))
    assert {r.fichier[-6:]: r.intact for r in C.verify(m, f).collect()} == {"01.csv": False, "02.csv": True}
    (tmp_path / "d.jsonl").write_text('{"a": 1}\n{"a": 2, "b": 3}\n')
    assert C.json_lines(spark, str(tmp_path / "d.jsonl")).count() == 2 and C.json_lines(spark, str(tmp_path / "d.jsonl"), "a int").agg(F.sum("a")).first()[0] == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    P.publish(df, str(tmp_path / "t"), ["y", "x"])
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["y", "x"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        P.publish(df, str(tmp_path / "t"), ["y", "x"])
    P.report_csv(df, str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_bytes() == b"x,y\n1,a\n2,\n"
    with pytest.raises(ValueError):
        P.report_csv(df, str(tmp_path / "r.csv"), most=1)
    P.report_json({"jour": "j"}, {"m": ("combien ?", df)}, str(tmp_path / "r.json"))
    assert '"mesures"' in (tmp_path / "r.json").read_text()
    assert (tmp_path / "r.csv").read_text() == "mesure,ligne,colonne,valeur\nm,0,x,1\nm,0,y,a\nm,1,x,2\nm,1,y,\n"


def test_a_json_report_is_whole_or_refused(spark, tmp_path):
    import json

    path = tmp_path / "r.json"
    P.report_json({}, {"m": ("q", spark.range(1000))}, str(path))
    kept = json.loads(path.read_text())["mesures"]["m"]
    assert len(kept["lignes"]) == 1000 and kept["question"] == "q" and kept["duree_s"] >= 0
    with pytest.raises(ValueError, match="more than 1000 rows in n"):
        P.report_json({}, {"m": ("q", spark.range(2)), "n": ("q", spark.range(1001))}, str(path))
    assert list(json.loads(path.read_text())["mesures"]) == ["m"]


def test_rows_are_replaced_by_key_and_tables_filled_again(spark, tmp_path):
    path = str(tmp_path / "stat")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    for new, want in ((rows((1, "a"), (2, "b")), {(1, "a"), (2, "b")}), (rows((2, "c"), (3, "d")), {(1, "a"), (2, "c"), (3, "d")}), (rows((1, "z")).limit(0), {(1, "a"), (2, "c"), (3, "d")})):
        P.replace_rows(spark, path, new, ["k"])
        assert {tuple(r) for r in spark.read.parquet(path).collect()} == want
    P.reload(rows((9, "x")), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(9, "x")]


def test_a_row_store_is_read_in_ranges_and_refuses_a_second_load(spark):
    url = "jdbc:derby:memory:essai;create=true"
    df = spark.range(250).selectExpr("id as n", "concat('x', id) as nom", "id % 7 as reste")
    P.jdbc_publish(df, url, "marches", ["nom", "n"])
    back = P.jdbc_read(spark, url, "marches", split=("n", 0, 250, 4))
    assert back.columns == ["nom", "n"] and back.rdd.getNumPartitions() == 4 and back.count() == 250
    some = P.jdbc_read(spark, url, "marches").filter("n >= 240")
    assert some.count() == 10 and "PushedFilters: [*IsNotNull(N), *GreaterThanOrEqual(N,240)]".lower() in some._jdf.queryExecution().toString().lower()
    with pytest.raises(ValueError, match="has rows already"):
        P.jdbc_publish(df, url, "marches", ["nom", "n"])


def test_lanes_of_pages_end_at_their_first_empty_page(spark):
    def fetch(offset, size):
        return [{"n": k} for k in range(offset, min(offset + size, 37))]

    for lanes, size in ((1, 10), (3, 5), (8, 100)):
        spark.dataSource.register(C.paged_source(f"pages_{lanes}", fetch, lanes, size))
        got = spark.read.format(f"pages_{lanes}").load().select(F.get_json_object("document", "$.n").cast("int")).collect()
        assert sorted(r[0] for r in got) == list(range(37))


def test_a_catalogue_resolves_exact_titles(spark):
    c = spark.createDataFrame([("a.csv", "u1"), ("decp.parquet", "u2"), (None, "u3")], "titre string, url string")
    assert C.resource(c, "decp.parquet") == "u2"
    with pytest.raises(LookupError):
        C.resource(c, "absent")


def test_columns_are_unified_by_name(spark, tmp_path):
    from ardoise.operators.layers import bronze

    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(f"{tmp_path}/d=1")
    spark.createDataFrame([(3, "x")], "b int, c string").write.parquet(f"{tmp_path}/d=2")
    assert set(bronze(spark, str(tmp_path)).columns) == {"a", "b", "c", "d"}


def test_streams(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), i % 3, "view", 1.0, "{}") for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/x")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/x").schema).parquet(f"{tmp_path}/x")
    out = E.complete(E.windows(stream), "t")
    assert out.agg(F.sum("n")).first()[0] == 40 and out.count() == 5
    seen = []
    E.run_available(E.windows(stream), lambda df, k: seen.append(df.count()), f"essai-{tmp_path.name}")
    assert sum(seen) == 5
