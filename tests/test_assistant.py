import pytest
from pyspark.sql import functions as F

from ardoise.functions.snowball import stem
from ardoise.operators import assistant as A
from ardoise.operators import index as X

SHARES = {"ascenseurs": 0.01, "travaux": 0.5, "ecole": 0.02, "toiture": 0.004, "logiciels": 0.007, "quel": 0.0001, "de": A.STOP_WORD, "pour": A.STOP_WORD, "en": A.STOP_WORD, "les": A.STOP_WORD, "la": A.STOP_WORD}
LEX = A.Lexicons(("Pays de Haut", "Haut"), ("Val", "Val d'Or"), 2015, 2024, lambda w: SHARES.get(w, 0.0))


@pytest.mark.parametrize(
    ("text", "intent"),
    [("Qui a remporté les travaux d'école ?", "titulaires"), ("qui fournit des logiciels", "titulaires"), ("quelles entreprises pour la toiture", "titulaires"), ("Qui achète le plus de logiciels ?", "acheteurs"), ("quelles communes, toiture", "acheteurs"),
     ("marchés atypiques de toiture", "signales"), ("combien coûte la toiture", "montant"), ("budget école", "montant"), ("combien de marchés de toiture", "comptage"), ("toiture", "extraits"), ("quel est le meilleur fournisseur ?", "refus"), ("qui a fraudé", "refus")],
)
def test_intents(text, intent):
    assert A.read_question(text, LEX).intent == intent


def test_steps_take_their_words_away():
    q = A.read_question("Quels titulaires pour les ascenseurs en Pays de Haut en 2019 ?", LEX)
    assert (q.intent, q.terms, q.year, q.region, q.refusal) == ("titulaires", ("ascenseurs",), 2019, "Pays de Haut", None)
    assert A.read_question("Combien de marchés école, Val d'Or", LEX).department == "Val d'Or"
    assert A.read_question("quel montant total pour la toiture", LEX).terms == ("toiture",)
    assert A.read_question("1500 repas, toiture", LEX).year is None
    q = A.read_question("travaux de toiture quel marché x", LEX)
    assert dict(q.set_aside) == {"travaux": "trop frequent", "de": "mot vide", "quel": "trop rare", "marche": "nomme les donnees", "x": "trop court"} and q.lost == ("quel",)


def test_refusals():
    assert A.read_question("ascenseurs 1999", LEX).refusal == "annee hors des donnees"
    # The only word of content is lost: the year alone would answer another question.
    assert A.read_question("combien de marchés de dsfgdsfg en 2023", LEX).refusal == "mots perdus"
    assert A.read_question("combien de marchés en 2023", LEX).refusal is None
    assert A.read_question("combien de marchés ?", LEX).refusal == "aucun critere" and A.read_question(None, LEX).refusal == "aucun critere"


ROWS = [
    (i, f"m{i}", "Réfection de la toiture" if i % 2 else "Achat de logiciels pour l'école", f"Mairie {i % 3}", f"Firme {i % 4}" if i % 5 else None, float(i) if i % 7 else None, 2019 + i % 2, f"R{i % 3}", f"D{i % 6}", True)
    for i in range(60)
]


@pytest.fixture(scope="module")
def asked(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('assistant')}/m.parquet"
    spark.createDataFrame(ROWS, "id long, marche_id string, objet string, acheteur_nom string, titulaire_nom string, montant double, annee int, acheteur_region_nom string, acheteur_departement_nom string, donneesActuelles boolean").write.parquet(path)
    df = spark.read.parquet(path)
    ix = X.index(df, [("objet", "A"), ("acheteur_nom", "B"), ("titulaire_nom", "B")], "assistant")
    vocabulary = X.frequencies(ix).withColumn("marches", F.when(F.col("lexeme").isin(stem("toiture"), stem("logiciels")), F.lit(1)).otherwise(F.col("marches"))).withColumn("echantillon", F.lit(60))
    signals = spark.createDataFrame([("m1", 2, 5.0), ("m3", 1, 9.0), ("m5", 0, 99.0)], "marche_id string, signaux_forts int, ecart_normalise_famille double")
    texts = ["combien de toitures en 2020", "qui fournit des logiciels", "montant toiture R1", "toiture suspecte", "2020 D3", "rien du tout", "qui a fraudé", "qui achète des toitures", "logiciel en 2020"]
    questions = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)] + [("n", None)], "question_id string, texte string")
    read = A.read_questions(questions, vocabulary, A.lexicons(df))
    return df, ix, read, A.answers(read, df, signals, ix).cache()


def test_answers_equal_brute_force(asked):
    got = {r.question_id: r for r in asked[3].collect()}
    roof = [r for r in ROWS if r[0] % 2]
    assert got["0"].marches == sum(r[6] == 2020 for r in roof) and got["0"].total == sum(r[5] or 0 for r in roof if r[6] == 2020)
    assert got["0"].citations == [r[0] for r in sorted((r for r in roof if r[6] == 2020), key=lambda r: -(r[5] or -1))[:3]]
    soft = [r for r in ROWS if not r[0] % 2]
    counts = {n: sum(r[4] == n for r in soft) for n in {r[4] for r in soft} - {None}}
    assert {x.nom: x.marches for x in got["1"].lignes} == counts and all(1 <= len(x.citations) <= 3 for x in got["1"].lignes)
    amounts = sorted(r[5] for r in roof if r[7] == "R1" and r[5] is not None)
    assert got["2"].mediane == pytest.approx((amounts[(len(amounts) - 1) // 2] + amounts[len(amounts) // 2]) / 2) and got["2"].avec_montant == len(amounts)
    assert got["3"].citations == [1, 3]
    assert got["4"].marches == sum(r[6] == 2020 and r[8] == "D3" for r in ROWS)
    assert got["5"].refus == "mots perdus" and got["6"].refus == "jugement" and got["n"].refus == "aucun critere" and got["6"].marches is None and got["6"].citations == []
    assert {x.nom for x in got["7"].lignes} == {r[3] for r in roof}
    assert got["8"].marches == 0 and got["8"].citations == []


def test_checks_find_nothing_in_true_answers_and_something_in_false_ones(spark, asked):
    df, ix, read, answered = asked
    fields = ["objet", "acheteur_nom", "titulaire_nom"]
    assert A.false_citations(read, answered, df, fields).filter("citations_fausses > 0").count() == 0
    count = {r.filtre: r.recompte for r in A.recounted(read, df, ix).collect()}
    assert all(r.marches == count.get(r.filtre, 0) for r in answered.filter("refus is null and question_id <> '4'").collect())
    assert answered.filter(F.size(A.broken_rules()) > 0).count() == 0
    wrong = answered.filter("question_id = '0'").withColumn("citations", F.array(F.lit(2), F.lit(999), F.lit(1)).cast("array<bigint>")).withColumn("total", F.lit(-1.0))
    assert A.false_citations(read, wrong, df, fields).first()[1:] == (3, 2 + (2019 + 1 % 2 != 2020))
    assert wrong.select(A.broken_rules()).first()[0] == ["total negatif"]


def test_filters_that_share_words_are_counted_alike_both_ways(spark, tmp_path):
    words = [f"mot{c}k" for c in "bcdfghjklmnp"]
    rows = [(i, f"m{i}", " ".join(words[i % 3 :]), "Mairie", None, 1.0, 2019, "R", "D", True) for i in range(300)]
    spark.createDataFrame(rows, "id long, marche_id string, objet string, acheteur_nom string, titulaire_nom string, montant double, annee int, acheteur_region_nom string, acheteur_departement_nom string, donneesActuelles boolean").write.parquet(f"{tmp_path}/m.parquet")
    df = spark.read.parquet(f"{tmp_path}/m.parquet")
    ix = X.index(df, [("objet", "A")], "partages")
    texts = [f"{a} {b}" for k, a in enumerate(words) for b in words[k + 1 :]]
    vocabulary = X.frequencies(ix).withColumn("marches", F.lit(5)).withColumn("echantillon", F.lit(100))
    read = A.read_questions(spark.createDataFrame([(t, t) for t in texts], "question_id string, texte string"), vocabulary, A.lexicons(df))
    count = {r.filtre: r.recompte for r in A.recounted(read, df, ix).collect()}
    held = {r.filtre: r.question_id for r in read.collect()}
    assert {held[f]: n for f, n in count.items()} == {t: sum(set(t.split(" ")) <= set(r[2].split(" ")) for r in rows) for t in texts}
    assert {r.filtre: r["count"] for r in A.matched(read, df, ix).groupBy("filtre").count().collect()} == count
