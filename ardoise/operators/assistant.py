"""Rule-based question answering: a question becomes an intent and a filter, the answer a figure with citations.

Reading takes one step after the other, and each takes the words that it understood away from the rest:
a demand for a judgement is refused; then the intent, superlatives, the year, the place; what is left
is held against how often the texts have it.  A word that is lost (absent or too rare) makes the answer
say so, and a question of which only lost words are left is refused.

Answering works on all questions at once: their rarest words are joined with the stored postings, the
other words, year and place filter what comes out, and every figure is an aggregate by question.  Each
answer is checked: cited rows are looked up under the question's filter in the texts themselves, the
count is taken again along another way, and rules of coherence are applied.

Defined results: null and empty questions are refused; a question that matches nothing counts zero and
cites nothing; equal amounts are cited in the order of ids; empty tables answer zero.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ardoise.functions.snowball import stem, stems
from ardoise.functions.text import fold
from ardoise.operators.index import Index
from ardoise.operators.search import STOP, tokens
from ardoise.session import BROADCAST_ROWS, materialise, small

# Wordings of what is asked for, folded, in the order in which they are tried.
INTENTS = {
    "titulaires": (
        r"qui (?:a |ont )?(?:remport\w+|obten\w+|gagn\w+|eu|decroch\w+)", r"qui (?:fournit|fournissent|realise|realisent|livre|livrent|travaille)",
        r"quel\w* (?:entrepris\w+|societ\w+|titulair\w+|fournisseur\w*|prestatair\w+|attributair\w+)", r"attribu\w+ a qui", r"titulair\w+",
    ),
    "acheteurs": (r"qui achet\w+", r"quel\w* achet\w+", r"quel\w* (?:collectivit\w+|commun\w+|mairi\w+|administrat\w+|departement\w*|region\w*|etablissement\w*)"),
    "signales": (r"signal\w+", r"atypiqu\w+", r"suspect\w*", r"anormal\w*", r"anormau\w*", r"alert\w+", r"inhabituel\w*", r"etrange\w*"),
    "montant": (r"montant\w*", r"total\w*", r"somme\w*", r"cout\w*", r"budget\w*", r"depens\w+", r"combien (?:coute|coutent|a coute|ca coute)"),
    "comptage": (r"combien", r"nombre d[eu]", r"quantite"),
}
# Wordings that ask for a judgement or accuse.
JUDGEMENTS = (
    r"meilleur\w*", r"pire\w*", r"bon marche", r"recommand\w+", r"conseill\w+", r"devrai\w+", r"faut il", r"dois je", r"fiable\w*", r"honnete\w*", r"serieu\w+", r"competent\w*",
    r"corromp\w+", r"fraud\w+", r"coupable\w*", r"malhonnete\w*", r"triche\w*", r"vole\w*",
)
# Superlatives, which every ranking answers anyway.
SUPERLATIVES = ("le plus", "les plus", "la plus", "le moins", "les moins", "davantage", "surtout")
# Words that name the data, not what they hold.
SCHEMA_WORDS = frozenset("marche marches contrat contrats lot lots appel appels offre offres donnee donnees liste lister montre montrer donne donner cherche chercher trouve trouver affiche afficher".split())
# Bounds of the share of texts that a word of a question may have, and years that a number may be.
RARE, FREQUENT = 0.0005, 0.12
YEARS = (1990, 2100)
# What the frequency of a stop word reads.
STOP_WORD = -1.0
TOP, CITED = 10, 3
MOST_PLACES = 10_000


def wording(parts: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(parts) + r")\b"


@dataclass(frozen=True)
class Lexicons:
    """What the data knows: place names, the years covered, and the share of texts with a word (STOP_WORD for stop words, 0 if absent)."""

    regions: tuple[str, ...] = ()
    departments: tuple[str, ...] = ()
    first_year: int = YEARS[0]
    last_year: int = YEARS[1]
    frequency: Callable[[str], float] = field(default=lambda w: 0.0)


@dataclass(frozen=True)
class Question:
    intent: str
    terms: tuple[str, ...] = ()
    year: int | None = None
    region: str | None = None
    department: str | None = None
    lost: tuple[str, ...] = ()
    set_aside: tuple[tuple[str, str], ...] = ()
    refusal: str | None = None


def plain(s: str | None) -> str:
    s = unicodedata.normalize("NFKD", (s or "").lower())
    return re.sub(r"[^a-z0-9]+", " ", "".join(c for c in s if not unicodedata.combining(c))).strip()


def _without(pattern: str, text: str) -> str:
    return " ".join(re.sub(pattern, " ", text).split())


def read_question(text: str | None, lex: Lexicons) -> Question:
    """Refusal, intent, year, place, words."""
    rest = plain(text)
    if re.search(wording(JUDGEMENTS), rest):
        return Question("refus", refusal="jugement")
    intent = next((name for name, parts in INTENTS.items() if re.search(wording(parts), rest)), "extraits")
    if intent in INTENTS:
        rest = _without(wording(INTENTS[intent]), rest)
    rest = _without(wording(SUPERLATIVES), rest)
    year, number = None, re.search(r"\b(\d{4})\b", rest)
    if number and YEARS[0] <= int(number[1]) <= YEARS[1]:
        year, rest = int(number[1]), rest.replace(number[1], " ")
        if not lex.first_year <= year <= lex.last_year:
            return Question("refus", year=year, refusal="annee hors des donnees")
    found: dict[str, str | None] = {}
    for kind, places in (("region", lex.regions), ("department", lex.departments)):
        folded = sorted(((plain(p), p) for p in places), key=lambda x: (-len(x[0]), x))
        found[kind] = next((name for p, name in folded if p and re.search(rf"\b{re.escape(p)}\b", rest)), None)
        if found[kind]:
            rest = _without(rf"\b{re.escape(plain(found[kind]))}\b", rest)
    terms, lost, aside = [], [], []
    for w in rest.split():
        share = lex.frequency(w) if w not in SCHEMA_WORDS and len(w) >= 2 else None
        if share is not None and RARE <= share <= FREQUENT:
            terms.append(w)
            continue
        reason = "nomme les donnees" if w in SCHEMA_WORDS else "trop court" if share is None else "mot vide" if share == STOP_WORD else "absent" if share <= 0 else "trop rare" if share < RARE else "trop frequent"
        aside.append((w, reason))
        if reason in ("absent", "trop rare"):
            lost.append(w)
    criteria = {"year": year, "region": found["region"], "department": found["department"]}
    refusal = None
    if not terms:
        refusal = "mots perdus" if lost else None if any(criteria.values()) else "aucun critere"
    return Question("refus" if refusal else intent, tuple(dict.fromkeys(terms)), lost=tuple(lost), set_aside=tuple(aside), refusal=refusal, **criteria)


def lexicons(df: DataFrame) -> Lexicons:
    """Places and years of a table of awards; word frequencies are joined, not collected."""
    def places(c: str) -> tuple[str, ...]:
        found = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(MOST_PLACES + 1).collect()]
        if len(found) > MOST_PLACES:
            raise ValueError(f"more than {MOST_PLACES} places in {c}: that is no column of regions or departments")
        return tuple(found)

    span = df.filter(F.col("annee").between(*YEARS)).agg(F.min("annee"), F.max("annee")).first()
    return Lexicons(places("acheteur_region_nom"), places("acheteur_departement_nom"), span[0] or YEARS[0], span[1] or YEARS[1])


READ = "question_id string, texte string, intention string, refus string, mots array<string>, lexemes array<string>, rare string, annee int, region string, departement string, perdus array<string>"


def _reader(lex: Lexicons):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, words, shares in zip(pdf["question_id"], pdf["texte"], pdf["_mots"], pdf["_parts"], strict=True):
                share = dict(zip(words, shares, strict=True))
                own = Lexicons(lex.regions, lex.departments, lex.first_year, lex.last_year, lambda w, share=share: share.get(w, STOP_WORD if w in STOP else 0.0))
                q = read_question(text, own)
                lexemes = list(dict.fromkeys(stem(t) for t in q.terms))
                rarest = min(((share.get(t, 0.0), stem(t)) for t in q.terms), default=(0.0, None))[1]
                rows.append((key, text, q.intent, q.refusal, list(q.terms), lexemes, rarest, q.year, q.region, q.department, list(q.lost)))
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in READ.split(", ")])
            yield out.assign(annee=out["annee"].astype("Int32"))

    return read


def word_shares(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(question_id, mot, lexeme, part): every word of each question with the share of texts that have its lexeme.

    vocabulary: lexeme, marches, echantillon.  Stop words read STOP_WORD, absent words 0.
    """
    words = questions.select("question_id", F.explode(F.array_distinct(F.filter(F.split(F.coalesce(fold(F.col("texte")), F.lit("")), " "), lambda w: w != ""))).alias("mot"))
    x = words.withColumn("lexeme", stems(F.array("mot"))[0]).join(vocabulary.select("lexeme", (F.col("marches") / F.col("echantillon")).alias("_part")), "lexeme", "left")
    return x.select("question_id", "mot", "lexeme", F.when(F.col("mot").isin(STOP), F.lit(STOP_WORD)).otherwise(F.coalesce("_part", F.lit(0.0))).alias("part"))


def read_questions(questions: DataFrame, vocabulary: DataFrame, lex: Lexicons) -> DataFrame:
    """Every question (question_id, texte) as read, with its lexemes."""
    shares = word_shares(questions, vocabulary).groupBy("question_id").agg(F.collect_list("mot").alias("_mots"), F.collect_list("part").alias("_parts"))
    x = questions.join(shares, "question_id", "left").withColumn("_mots", F.coalesce("_mots", F.array().cast("array<string>"))).withColumn("_parts", F.coalesce("_parts", F.array().cast("array<double>")))
    # Questions that set the same filter are matched once.
    y = x.mapInPandas(_reader(lex), READ).withColumn("filtre", F.xxhash64(F.array_join(F.array_sort("lexemes"), " "), F.coalesce(F.col("annee").cast("string"), F.lit("-")), F.coalesce("region", F.lit("-")), F.coalesce("departement", F.lit("-"))))
    return materialise(y, "questions-lues")


def _placed(df: DataFrame) -> DataFrame:
    """Rows that agree with the year and place of their question."""
    same = lambda own, asked: F.col(asked).isNull() | (F.col(own) == F.col(asked))
    return df.filter(same("m_annee", "annee") & same("m_region", "region") & same("m_departement", "departement"))


def _rows(df: DataFrame) -> DataFrame:
    return df.select("id", "marche_id", "montant", "titulaire_nom", "acheteur_nom", F.col("annee").alias("m_annee"), F.col("acheteur_region_nom").alias("m_region"), F.col("acheteur_departement_nom").alias("m_departement"))


ASKED = ("filtre", "annee", "region", "departement")


def _asked_words(worded: DataFrame, ix: Index) -> DataFrame:
    """(id, _mots): of every row the words that some question asks for, sorted; of the postings only those of these words are read."""
    asked = small(worded.select(F.explode("lexemes").alias("lexeme")).distinct(), "lexemes-demandes")
    return ix.postings.select("id", "lexeme").join(asked, "lexeme", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("lexeme")).alias("_mots"))


def matched(read: DataFrame, df: DataFrame, ix: Index) -> DataFrame:
    """(filtre, and the row's columns): every row that passes the filter of some question."""
    live = read.filter(F.col("refus").isNull()).dropDuplicates(["filtre"])
    worded = live.filter(F.size("lexemes") > 0)
    filters = small(worded.select(*ASKED, "lexemes", "rare"), "filtres")
    # A row is held against the filters whose rarest word it has, with all its words at hand: no candidate is written or shuffled.
    near = _asked_words(worded, ix).join(_rows(df), "id").withColumn("rare", F.explode("_mots")).join(filters, "rare")
    by_words = _placed(near.filter(F.size(F.array_except("lexemes", "_mots")) == 0))
    # Questions of a year or place alone are held against all rows; few by nature, and counted.
    bare = live.filter(F.size("lexemes") == 0).select(*ASKED)
    if bare.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} questions without words at a time")
    same = lambda own, asked: F.col(asked).isNull() | (F.col(own) == F.col(asked))
    by_place = _rows(df).join(F.broadcast(bare), same("m_annee", "annee") & same("m_region", "region") & same("m_departement", "departement"))
    columns = ["filtre", "id", "marche_id", "montant", "titulaire_nom", "acheteur_nom"]
    return materialise(by_words.select(*columns).unionByName(by_place.select(*columns)), "reponses")


def _largest(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, citations): the ids of the n largest amounts."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("montant"), "id")
    top = df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "id"))), lambda s: s["id"]).alias("citations"))


LINE = "array<struct<nom:string,marches:bigint,total:double,citations:array<bigint>>>"


def _named(rows: DataFrame, name: str, out: str) -> DataFrame:
    """(filtre, out): the names with most rows, each with its largest contracts."""
    named = rows.filter(F.col(name).isNotNull()).withColumnRenamed(name, "nom")
    totals = named.groupBy("filtre", "nom").agg(F.count(F.lit(1)).alias("marches"), F.coalesce(F.sum("montant"), F.lit(0.0)).alias("total"))
    w = Window.partitionBy("filtre").orderBy(F.desc("marches"), F.desc("total"), "nom")
    top = totals.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= TOP)
    cited = _largest(named.join(top.select("filtre", "nom"), ["filtre", "nom"]), ["filtre", "nom"], CITED)
    lines = top.join(cited, ["filtre", "nom"]).groupBy("filtre").agg(F.array_sort(F.collect_list(F.struct("_k", "nom", "marches", "total", "citations"))).alias("l"))
    return lines.select("filtre", F.transform("l", lambda s: F.struct(s["nom"].alias("nom"), s["marches"].alias("marches"), s["total"].alias("total"), s["citations"].alias("citations"))).cast(LINE).alias(out))


def answers(read: DataFrame, df: DataFrame, signals: DataFrame, ix: Index) -> DataFrame:
    """One row per question: intent, refusal, figures, citations, listed names and the words that were lost."""
    rows = matched(read, df, ix)
    asked = lambda kind: rows.join(read.filter(F.col("refus").isNull() & (F.col("intention") == kind)).select("filtre").distinct(), "filtre", "left_semi")
    figures = rows.groupBy("filtre").agg(F.count(F.lit(1)).alias("marches"), F.count("montant").alias("avec_montant"), F.coalesce(F.sum("montant"), F.lit(0.0)).alias("total"))
    median = asked("montant").filter("montant is not null").groupBy("filtre").agg(F.percentile("montant", 0.5).alias("_mediane"))
    strong = signals.filter("signaux_forts > 0").select("marche_id", "signaux_forts", "ecart_normalise_famille")
    w = Window.partitionBy("filtre").orderBy(F.desc("signaux_forts"), F.desc_nulls_last("ecart_normalise_famille"), "id")
    flagged = asked("signales").join(strong, "marche_id").withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= TOP)
    flagged = flagged.groupBy("filtre").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "id"))), lambda s: s["id"]).alias("_signales"))
    cited = _largest(rows, ["filtre"], CITED).withColumnRenamed("citations", "_trois")
    excerpts = _largest(asked("extraits"), ["filtre"], TOP).withColumnRenamed("citations", "_dix")
    x = read.join(figures, "filtre", "left")
    for part in (median, _named(asked("titulaires"), "titulaire_nom", "_titulaires"), _named(asked("acheteurs"), "acheteur_nom", "_acheteurs"), cited, flagged, excerpts):
        x = x.join(part, "filtre", "left")
    none, kind, live = F.array().cast("array<bigint>"), F.col("intention"), F.col("refus").isNull()
    x = x.withColumn("lignes", F.when(kind == "titulaires", F.col("_titulaires")).when(kind == "acheteurs", F.col("_acheteurs"))).withColumn("mediane", F.when(kind == "montant", F.col("_mediane")))
    listed = F.coalesce(F.flatten(F.transform("lignes", lambda s: s["citations"])), none)
    citations = F.when(~live, none).when(kind == "signales", F.coalesce("_signales", none)).when(kind == "extraits", F.coalesce("_dix", none)).otherwise(F.concat(F.coalesce("_trois", none), listed))
    only = lambda c: F.when(live, c)
    return x.select("question_id", "filtre", "texte", "intention", "refus", "perdus", only(F.coalesce("marches", F.lit(0))).alias("marches"), only(F.col("avec_montant")).alias("avec_montant"), only(F.round("total", 2)).alias("total"), "mediane", F.array_distinct(citations).alias("citations"), "lignes")


def recounted(read: DataFrame, df: DataFrame, ix: Index) -> DataFrame:
    """(filtre, recompte): matching rows counted along another way: by sets of words, years and places, every word of a filter alike, none first.

    Filters meet the distinct sets of words, not the rows: many questions share a frequent word.
    """
    live = read.filter(F.col("refus").isNull() & (F.size("lexemes") > 0)).dropDuplicates(["filtre"])
    placed = ("m_annee", "m_region", "m_departement")
    sets = materialise(_asked_words(live, ix).join(_rows(df).select("id", *placed), "id").groupBy("_mots", *placed).agg(F.count(F.lit(1)).alias("_lignes")), "ensembles-de-mots")
    hits = sets.select("_mots").distinct().select("_mots", F.explode("_mots").alias("lexeme")).join(live.select(*ASKED, F.size("lexemes").alias("_n"), F.explode("lexemes").alias("lexeme")), "lexeme")
    full = hits.groupBy(*ASKED, "_n", "_mots").agg(F.count_distinct("lexeme").alias("_k")).filter("_k = _n")
    return _placed(full.join(sets, "_mots")).groupBy("filtre").agg(F.sum("_lignes").alias("recompte"))


def false_citations(read: DataFrame, answered: DataFrame, df: DataFrame, fields: list[str]) -> DataFrame:
    """(question_id, citations_lues, citations_fausses): cited rows looked up in the table and held against the question, in the texts themselves."""
    cited = answered.select("question_id", "filtre", F.explode("citations").alias("id"))
    claims = cited.select("filtre", "id").distinct().join(read.dropDuplicates(["filtre"]).select(*ASKED, "lexemes"), "filtre")
    x = claims.join(_rows(df).withColumn("_la", F.lit(True)).join(df.select("id", *[F.col(c).alias(f"_texte{k}") for k, c in enumerate(fields)]), "id"), "id", "left")
    for k in range(len(fields)):
        x = x.withColumn(f"_lex{k}", stems(tokens(F.col(f"_texte{k}"))))
    words = F.flatten(F.array(*[F.col(f"_lex{k}") for k in range(len(fields))]))
    same = lambda own, asked: F.col(asked).isNull() | F.coalesce(F.col(own) == F.col(asked), F.lit(False))
    true = F.coalesce("_la", F.lit(False)) & (F.size(F.array_except("lexemes", words)) == 0) & same("m_annee", "annee") & same("m_region", "region") & same("m_departement", "departement")
    judged = x.select("filtre", "id", true.alias("_vrai"))
    return cited.join(judged, ["filtre", "id"]).groupBy("question_id").agg(F.count(F.lit(1)).alias("citations_lues"), F.count_if(~F.col("_vrai")).alias("citations_fausses"))


def broken_rules() -> Column:
    """The rules of coherence that a row of ``answers`` breaks."""
    listed = F.aggregate(F.coalesce("lignes", F.array().cast(LINE)), F.lit(0).cast("bigint"), lambda n, s: n + s["marches"])
    rules = (
        ("plus de montants que de marches", F.col("avec_montant") > F.col("marches")), ("total negatif", F.col("total") < 0), ("mediane negative", F.col("mediane") < 0),
        ("plus de marches par nom qu'en tout", listed > F.col("marches")), ("des noms sans marche", (F.col("marches") == 0) & (F.size(F.coalesce("lignes", F.array().cast(LINE))) > 0)),
        ("des marches sans citation", (F.col("marches") > 0) & (F.size("citations") == 0) & (F.col("intention") != "signales")),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))


def intent_column(text: Column) -> Column:
    """The intent of many questions at once."""
    t = fold(text)
    out = F.when(t.rlike(wording(JUDGEMENTS)), "refus")
    for name, parts in INTENTS.items():
        out = out.when(t.rlike(wording(parts)), name)
    return out.otherwise("extraits")


def year_column(text: Column) -> Column:
    """The first four-digit number of each text, if it can be a year."""
    y = F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(\d{4})\b", 1).try_cast("int")
    return F.when(y.between(*YEARS), y)
