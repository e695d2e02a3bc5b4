"""Queries of question answering, over the questions that users asked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ardoise.operators import assistant as A
from ardoise.operators import index as X
from ardoise.operators.layers import current
from ardoise.operators.search import tokens
from ardoise.plans import oracle as O
from ardoise.plans.search import _DOC, _STOP, _ix
from ardoise.session import materialise, table


def _questions(spark, d):
    x = table(spark, d, "recherche").select("question_id", "question").filter("question is not null").distinct()
    asked = F.array(F.lit(""), F.lit("Combien de marchés pour "), F.lit("Quels titulaires pour "), F.lit("Montant médian en 2019 pour "), F.lit("Acheteurs corrompus pour "))
    return x.select("question_id", F.explode(asked).alias("debut"), "question").select("question_id", F.concat("debut", "question").alias("texte"))


def questions_intentions(spark, d):
    """QA-1, QA-2, QA-4: intent, refusal and year of many questions at once."""
    return _questions(spark, d).select("question_id", "texte", A.intent_column(F.col("texte")).alias("intention"), A.year_column(F.col("texte")).alias("annee"))


def questions_mots(spark, d):
    """QA-3, QA-6: words of each question that the data knows, with how many subjects have them."""
    q = table(spark, d, "recherche").select("question_id", "question").filter("question is not null").distinct().select("question_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("mot"))
    f = current(table(spark, d, "marches")).select(F.explode(F.array_distinct(tokens(F.col("objet")))).alias("mot")).groupBy("mot").agg(F.count(F.lit(1)).alias("marches"))
    return q.join(f, "mot", "left").select("question_id", "mot", F.coalesce("marches", F.lit(0)).alias("marches"))


def mediane_a_la_demande(spark, d):
    """QA-9, AGG-28: count, amounts and median under a filter."""
    x = X.rows_of(current(table(spark, d, "marches")).filter("annee = 2019"), X.having_all(_ix(spark, d), ["maintenance"], "A"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.count("montant").alias("avec"), F.percentile("montant", 0.5).alias("mediane"))


def frequences_demandees(spark, d):
    """FTS-9, QA-6: the share of documents of every word asked for; -1 for stop words, 0 for absent ones."""
    asked = spark.createDataFrame([("1", "la maintenance de l'école"), ("2", "toiture introuvable zzqqx")], "question_id string, texte string")
    return A.word_shares(asked, X.frequencies(_ix(spark, d))).select("question_id", "mot", F.round("part", 8).alias("part"))


def _answered(spark, d):
    df, ix = current(table(spark, d, "marches")), _ix(spark, d)
    asked = _questions(spark, d).select("texte").distinct().select(F.sha2("texte", 256).alias("question_id"), "texte")
    read = A.read_questions(asked, X.frequencies(ix), A.lexicons(df))
    return read, A.answers(read, df, table(spark, d, "signaux"), ix), df, ix


def reponses(spark, d):
    """QA-1 to QA-8: every question of the table, and wordings around it, read and answered, each figure with its citations."""
    return _answered(spark, d)[1].drop("question_id", "filtre")


def reponses_verifiees(spark, d):
    """QA-10: by intent, how many answers, citations that don't hold, counts that differ when taken again, and broken rules."""
    read, answered, df, ix = _answered(spark, d)
    answered = materialise(answered, "reponses")
    x = answered.join(A.false_citations(read, answered, df, ["objet", "acheteur_nom", "titulaire_nom"]), "question_id", "left").join(A.recounted(read, df, ix), "filtre", "left").join(read.select("question_id", F.size("lexemes").alias("_mots")), "question_id")
    differs = (F.col("_mots") > 0) & F.col("refus").isNull() & (F.col("marches") != F.coalesce("recompte", F.lit(0)))
    return x.groupBy("intention").agg(
        F.count(F.lit(1)).alias("questions"), F.coalesce(F.sum("citations_lues"), F.lit(0)).alias("citations"), F.coalesce(F.sum("citations_fausses"), F.lit(0)).alias("citations_fausses"),
        F.count_if(differs).alias("recomptes_differents"), F.count_if(F.size(A.broken_rules()) > 0).alias("incoherentes"),
    )


_Q = "q as (select distinct question_id, question from recherche where question is not null)"


def _re(p: str) -> str:
    return p.replace("'", "''")


ORACLES = {
    "questions_intentions": f"with {_Q}, t as (select question_id, p || question as texte from q, (values (''), ('Combien de marchés pour '), ('Quels titulaires pour '), ('Montant médian en 2019 pour '), ('Acheteurs corrompus pour ')) v(p)), f as (select *, {O.FOLD.format('texte')} as x from t) select question_id, texte, case when regexp_matches(x, '{_re(A.wording(A.JUDGEMENTS))}') then 'refus' "
    + " ".join(f"when regexp_matches(x, '{_re(A.wording(p))}') then '{n}'" for n, p in A.INTENTS.items())
    + r" else 'extraits' end as intention, case when try_cast(regexp_extract(texte, '\b(\d{4})\b', 1) as int) between 1990 and 2100 then try_cast(regexp_extract(texte, '\b(\d{4})\b', 1) as int) end as annee from f",
    "questions_mots": f"with {_Q}, w as (select question_id, unnest(list_distinct(list_filter(string_split({O.FOLD.format('question')}, ' '), lambda w: w <> '' and not list_contains({_STOP}, w)))) as mot from q), f as (select mot, count(*) as marches from (select unnest(list_distinct(list_filter(string_split(coalesce({O.FOLD.format('objet')}, ''), ' '), lambda w: w <> '' and not list_contains({_STOP}, w)))) as mot from marches where donneesActuelles) group by 1) select question_id, w.mot, coalesce(marches, 0) as marches from w left join f using (mot)",
    "mediane_a_la_demande": f"with {_DOC} select count(*) as n, count(montant) as avec, median(montant) as mediane from docs where annee = 2019 and list_contains(mots, 'mainten')",
    "frequences_demandees": f"with {_DOC}, v(question_id, mot, lexeme) as (values ('1', 'la', '-'), ('1', 'maintenance', 'mainten'), ('1', 'de', '-'), ('1', 'l', '-'), ('1', 'ecole', 'ecol'), ('2', 'toiture', 'toitur'), ('2', 'introuvable', 'introuv'), ('2', 'zzqqx', '=zzqqx')) select question_id, mot, case when lexeme = '-' then -1.0::double else round((select count(*) from docs where list_contains(mots, lexeme)) / (select count(*) from docs), 8) end as part from v",
}
QUERIES = {n: globals()[n] for n in [*ORACLES, "reponses", "reponses_verifiees"]}
