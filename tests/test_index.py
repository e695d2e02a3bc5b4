import pytest
from pyspark.sql import functions as F

from ardoise.functions.snowball import stem, stems
from ardoise.operators import index as X
from ardoise.operators import search as S

TEXTS = [
    ("Maintenance des ascenseurs de l'école", "Mairie", None), ("Travaux de toiture", "École du toit", "Maintenance Sud"), ("Entretien d'une école et maintenance du toit, écoles", "x", "y"),
    (None, None, None), ("", "Toitures et écoles", ""), ("Travaux de toiture", "École du toit", "Maintenance Sud"), ("toiture " * 40 + "école", "z", "z"),
]
FIELDS = [("objet", "A"), ("acheteur_nom", "B"), ("titulaire_nom", "B")]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/t.parquet"
    spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS)], "id long, objet string, acheteur_nom string, titulaire_nom string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def ix(table):
    return X.index(table, FIELDS, "essai")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize("terms", [["ecole"], ["maintenance", "ecoles"], ["toiture", "introuvable"], ["toitures"], []])
def test_searches_equal_those_over_arrays(table, ix, terms):
    arrays = table.withColumn("mots", stems(S.tokens(F.col("objet"))))
    wanted = X.lexemes(terms)
    assert ids(X.having_all(ix, terms, "A")) == ids(arrays.filter(S.match_all(F.col("mots"), wanted)))
    assert ids(X.having_any(ix, terms, "A")) == ids(arrays.filter(S.match_any(F.col("mots"), wanted)))
    if terms:
        modes = lambda df: sorted((r.id, r["mode"]) for r in df.collect())
        assert modes(X.cascade(ix, terms, "A")) == modes(S.cascade(arrays.select("id", "mots"), "mots", wanted).select("id", "mode"))
        close = {r.id: r.score for r in X.bm25(ix, terms).collect()}
        brute = {r.id: r.score for r in S.bm25(arrays, "id", "mots", wanted).collect()}
        assert close.keys() == brute.keys() and all(close[k] == pytest.approx(brute[k]) for k in brute)


def test_densities_equal_those_over_documents(table, ix):
    docs = table.withColumn("doc", S.document([(F.col(c), w) for c, w in FIELDS])).withColumn("doc", F.transform("doc", lambda x: x))
    rows = {r.id: r.doc for r in docs.collect()}
    for terms in (["ecole"], ["toiture", "ecole"]):
        wanted = X.lexemes(terms)
        brute = {}
        for k, doc in rows.items():
            places = [(x["position"], stem(x["lexeme"]), S.WEIGHTS[x["poids"]]) for x in doc]
            if set(wanted) <= {w for _, w, _ in places}:
                brute[k] = S.cover_density(places, wanted)
        assert {r.id: pytest.approx(r.score) for r in X.densities(ix, terms).collect()} == brute


def test_web_questions_and_weights(ix):
    assert ids(X.web(ix, S.parse("ecole -ascenseur"), "A")) == [2, 6]
    assert ids(X.web(ix, S.parse('"maintenance toit"'), "A")) == [2] and ids(X.web(ix, S.parse("de la"))) == []
    assert ids(X.having_all(ix, ["toiture", "maintenance"])) == [1, 5] and ids(X.having_all(ix, ["ecoles"], "B")) == [1, 4, 5]


def test_an_index_is_found_again_and_follows_its_files(spark, table, tmp_path):
    first = X.index(table, FIELDS, "essai").postings.inputFiles()
    assert X.index(table, FIELDS, "essai").postings.inputFiles() == first
    table.filter("id < 2").write.parquet(f"{tmp_path}/u.parquet")
    other = X.index(spark.read.parquet(f"{tmp_path}/u.parquet"), FIELDS, "essai")
    assert other.postings.inputFiles() != first and ids(X.having_any(other, ["ecole"])) == [0, 1]
    table.limit(0).write.parquet(f"{tmp_path}/v.parquet")
    assert ids(X.having_any(X.index(spark.read.parquet(f"{tmp_path}/v.parquet"), FIELDS, "essai"), ["ecole"])) == []


def test_a_search_reads_only_its_own_words(ix):
    plan = X.having_any(ix, ["ecole"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "lexeme" in plan.split("PushedFilters")[1].split("]")[0]
