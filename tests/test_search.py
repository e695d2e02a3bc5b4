import math

import pytest
from pyspark.sql import functions as F

from ardoise.operators import search as S

TEXTS = ["Maintenance des ascenseurs de l'école", "Travaux de toiture", "Entretien d'une école et maintenance du toit, école", None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, texte string").withColumn("mots", S.tokens(F.col("texte")))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_tokens_drop_accents_and_stop_words(docs):
    assert docs.filter("id = 0").first().mots == ["maintenance", "ascenseurs", "ecole"]
    assert docs.filter("id >= 3").select(F.size("mots")).distinct().first()[0] == 0


def test_and_or_cascade(docs):
    assert ids(docs.filter(S.match_all(F.col("mots"), ["ecole", "maintenance"]))) == [0, 2]
    assert ids(docs.filter(S.match_any(F.col("mots"), ["toiture", "ascenseurs"]))) == [0, 1]
    assert ids(docs.filter(S.match_all(F.col("mots"), []))) == []
    assert {(r.id, r["mode"]) for r in S.cascade(docs.select("id", "mots"), "mots", ["toiture", "ecole"]).collect()} == {(0, "ou"), (1, "ou"), (2, "ou")}
    assert {(r.id, r["mode"]) for r in S.cascade(docs.select("id", "mots"), "mots", ["toiture"]).collect()} == {(1, "et")}


def test_web_questions(docs):
    assert S.parse('a "maintenance toit" toiture or ecole -ascenseurs') == S.Query((), (("toiture", "ecole"),), ("ascenseurs",), (("maintenance", "toit"),))
    assert ids(docs.filter(S.matches(F.col("mots"), S.parse('ecole -ascenseurs')))) == [2]
    assert ids(docs.filter(S.matches(F.col("mots"), S.parse('"maintenance toit"')))) == [2]
    assert ids(docs.filter(S.matches(F.col("mots"), S.parse("de la")))) == []


def test_bm25_by_hand(docs):
    got = {r.id: r.score for r in S.bm25(docs, "id", "mots", ["ecole"]).collect()}
    lengths = [3, 2, 5, 0, 0]
    average = sum(lengths) / 5
    idf = math.log((5 - 2 + 0.5) / (2 + 0.5) + 1)
    for i, tf in ((0, 1), (2, 2)):
        assert got[i] == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[i] / average)))
    assert set(got) == {0, 2}


def test_cover_density_prefers_close_words_and_heavy_fields():
    near = S.cover_density([(1, "a", 1.0), (2, "b", 1.0)], ["a", "b"])
    far = S.cover_density([(1, "a", 1.0), (9, "b", 1.0)], ["a", "b"])
    light = S.cover_density([(1, "a", 0.1), (2, "b", 0.1)], ["a", "b"])
    assert near > far > 0 and near > light and S.cover_density([(1, "a", 1.0)], ["a", "b"]) == 0


def test_pages_filters_and_bounds(spark, docs):
    assert ids(S.page(docs.orderBy("id"), 2, 2)) == [2, 3, 4]
    for bad in ((0, 10), (41, 10), (1, 101)):
        with pytest.raises(ValueError):
            S.page(docs, *bad)
    with pytest.raises(ValueError):
        S.filters(low=2, high=1)
    df = spark.createDataFrame([(1, 2020, 5.0, True), (2, 2020, None, None), (3, 2019, 9.0, False)], "id long, annee int, montant double, offre_unique boolean")
    assert ids(df.filter(S.filters())) == [1, 2, 3] and ids(df.filter(S.filters(year=2020, low=1))) == [1] and ids(df.filter(S.filters(single_bid=True))) == [1]


def test_the_bounded_ranking_ranks_the_most_recent_up_to_its_cap(spark, tmp_path):
    from ardoise.plans.search import classement_borne

    # Each third subject says the word twice; recent ones have large ids, and the last is not current.
    x = spark.range(1, 5104).select(
        "id", F.when(F.col("id") % 3 == 0, "Maintenance, maintenance du toit").otherwise("Maintenance du toit").alias("objet"), F.lit("Ville").alias("acheteur_nom"), F.lit("Maintenance Sud").alias("titulaire_nom"),
        F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("date_notification"), F.when(F.col("id") != 9, (F.col("id") % 7).cast("double")).alias("montant"), (F.col("id") < 5103).alias("donneesActuelles"),
    )
    for low, kept in ((5000, range(5000, 5103)), (1, range(103, 5103))):
        x.filter(F.col("id") >= low).write.mode("overwrite").parquet(f"{tmp_path}/marches.parquet")
        rows = sorted(classement_borne(spark, str(tmp_path)).collect(), key=lambda r: r.rang)
        assert [r.id for r in rows] == sorted(kept, key=lambda i: (i % 3 != 0, -(i % 7), i)) and [r.rang for r in rows] == list(range(1, len(kept) + 1))
        assert {(r.candidats_examines, r.classement_approche) for r in rows} == {(len(kept), low == 1)}
        assert rows[0].score == pytest.approx(2.4) and rows[-1].score == pytest.approx(1.4)


def test_numbers_are_found_in_addresses_and_texts(spark, tmp_path):
    from ardoise.plans.search import ids_dans_texte

    rows = [(1, "http://a/654321", "SIRET 99000103000019, lot 123456, encore 654321 et 1234567"), (2, None, "numéro 99000104000018"), (3, "http://a/111111", None), (4, None, None), (5, "http://a/000000", "")]
    spark.createDataFrame(rows, "doc_id long, url string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.contient, r.numero) for r in ids_dans_texte(spark, str(tmp_path)).collect())
    assert got == [(1, True, "123456"), (1, True, "654321"), (1, True, "99000103000019"), (2, False, "99000104000018"), (3, False, "111111")]
