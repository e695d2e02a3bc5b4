"""Full-text search: weighted documents, AND / OR / cascade matching, BM25 and cover density, pages.

A document is an array of (word, field, position); the postings are its exploded form.  Frequencies
come from aggregates with map-side combine, so one word that is in a third of all documents costs
counts, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ardoise.functions.text import fold

# French stop words (articles, prepositions, pronouns and forms of common verbs), folded.
STOP = (
    "a ai as au aux avec ayant c ce ces cette d dans de des du elle elles en est et eu eux il ils j je l la le les leur leurs lui m ma mais me mes moi mon n ne nos notre nous "
    "on ont ou par pas pour qu que qui s sa sans se ses si sont son sur t ta te tes toi ton tu un une vos votre vous y etre sous entre vers chez donc dont ni or"
).split()
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
CAP = 5_000
PAGES, SIZES, DEFAULT_SIZE = 40, 100, 10


def tokens(c: Column) -> Column:
    """Folded words without stop words, in order; an empty array for null."""
    words = F.split(F.coalesce(fold(c), F.lit("")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP))


def document(fields: list[tuple[Column, str]]) -> Column:
    """Array of (lexeme, poids, position) over weighted fields, positions running on."""
    def placed(words: Column, weight: str, offset: Column) -> Column:
        return F.transform(words, lambda w, i: F.struct(w.alias("lexeme"), F.lit(weight).alias("poids"), (i + 1 + offset).cast("int").alias("position")))

    parts, offset = [], F.lit(0)
    for c, weight in fields:
        t = tokens(c)
        parts.append(placed(t, weight, offset))
        offset = offset + F.size(t)
    return F.concat(*parts)


def query_terms(text: str) -> list[str]:
    """Words of a question, folded, without stop words, order kept, repeats dropped."""
    import re
    import unicodedata

    s = unicodedata.normalize("NFKD", text.lower())
    s = "".join(ch for ch in s if not unicodedata.combining(ch))
    return list(dict.fromkeys(w for w in re.sub(r"[^a-z0-9]+", " ", s).split() if w not in STOP))


@dataclass(frozen=True)
class Query:
    """A parsed web-style question: every word of ``all``, one of each alternative in ``any``, none of ``none``, phrases in order."""

    all: tuple[str, ...] = ()
    any: tuple[tuple[str, ...], ...] = ()
    none: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = ()


def parse(text: str) -> Query:
    """Quotes make phrases, ``or`` joins alternatives, a minus excludes."""
    import re

    phrases = [tuple(query_terms(p)) for p in re.findall(r'"([^"]*)"', text)]
    rest = re.sub(r'"[^"]*"', " ", text).split()
    all_, any_, none, k = [], [], [], 0
    while k < len(rest):
        group = [rest[k]]
        while k + 2 < len(rest) and rest[k + 1].lower() == "or":
            group.append(rest[k + 2])
            k += 2
        k += 1
        words = [w for g in group for w in query_terms(g.lstrip("-"))]
        if not words:
            continue
        if group[0].startswith("-"):
            none += words
        elif len(group) > 1:
            any_.append(tuple(words))
        else:
            all_ += words
    return Query(tuple(all_), tuple(any_), tuple(none), tuple(p for p in phrases if p))


def matches(words: Column, q: Query) -> Column:
    """Whether an array of words satisfies the question; a question without words matches nothing."""
    ok = F.lit(bool(q.all or q.any or q.phrases))
    for w in q.all:
        ok = ok & F.array_contains(words, w)
    for group in q.any:
        ok = ok & F.arrays_overlap(words, F.array(*[F.lit(w) for w in group]))
    for w in q.none:
        ok = ok & ~F.array_contains(words, w)
    for p in q.phrases:
        ok = ok & F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(p)} "))
    return ok


def match_all(words: Column, terms: list[str]) -> Column:
    return F.forall(F.array(*[F.lit(t) for t in terms]), lambda t: F.array_contains(words, t)) if terms else F.lit(False)


def match_any(words: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(t) for t in terms])) if terms else F.lit(False)


def cascade(df: DataFrame, words: str, terms: list[str]) -> DataFrame:
    """All words first; any word only where nothing has them all."""
    both = df.filter(match_all(F.col(words), terms)).withColumn("mode", F.lit("et"))
    none = both.limit(1).agg((F.count(F.lit(1)) == 0).alias("_vide"))
    either = df.crossJoin(F.broadcast(none)).filter(F.col("_vide") & match_any(F.col(words), terms)).drop("_vide").withColumn("mode", F.lit("ou"))
    return both.unionByName(either)


def bm25(df: DataFrame, key: str, words: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score): BM25 of every row that has one of the terms."""
    x = df.select(F.col(key).alias("_cle"), F.col(words).alias("_mots"))
    totals = x.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size("_mots")).alias("_longueur"), *[F.count_if(F.array_contains("_mots", t)).alias(f"_df{i}") for i, t in enumerate(terms)])
    held = x.filter(match_any(F.col("_mots"), terms)).crossJoin(F.broadcast(totals))
    score = F.lit(0.0)

    def occurrences(term: str) -> Column:
        return F.size(F.filter("_mots", lambda w: w == term))

    for i, t in enumerate(terms):
        tf = occurrences(t)
        idf = F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5) + 1.0)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("_mots") / F.col("_longueur")))
    return held.select(F.col("_cle").alias(key), score.alias("score"))


def cover_density(positions: list[tuple[int, str, float]], terms: list[str]) -> float:
    """Cover density of one document (Clarke, Cormack and Tudhope): every shortest extent that has all terms adds its weight over its length."""
    wanted, total = set(terms), 0.0
    hits = sorted((p, w, g) for p, w, g in positions if w in wanted)
    last: dict[str, tuple[int, float]] = {}
    previous = -1
    for p, w, g in hits:
        last[w] = (p, g)
        if len(last) == len(wanted):
            start = min(v[0] for v in last.values())
            if start > previous:
                weight = len(wanted) / sum(1 / v[1] for v in last.values())
                total += weight / (p - start + 1 - (len(wanted) - 1)) if p - start + 1 > len(wanted) - 1 else weight
                previous = start
    return total


def _densities(docs: pd.Series, terms: list[str]) -> list[float]:
    return [cover_density([(x["position"], x["lexeme"], WEIGHTS[x["poids"]]) for x in d], terms) for d in docs]


def ranked(df: DataFrame, key: str, doc: str, terms: list[str]) -> DataFrame:
    """(key, score): cover density with field weights, for rows that have every term."""
    lexemes = F.transform(doc, lambda x: x["lexeme"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_cle": pdf["_cle"], "score": _densities(pdf["_doc"], terms)})

    kind = dict(df.dtypes)[key]
    held = df.filter(match_all(lexemes, terms)).select(F.col(key).alias("_cle"), F.col(doc).alias("_doc"))
    return held.mapInPandas(score, f"_cle {kind}, score double").withColumnRenamed("_cle", key)


def page(df: DataFrame, number: int = 1, size: int = DEFAULT_SIZE) -> DataFrame:
    """One page of an ordered frame plus one row that tells whether another page follows."""
    if not 1 <= number <= PAGES or not 1 <= size <= SIZES:
        raise ValueError("page or size out of bounds")
    return df.offset((number - 1) * size).limit(size + 1)


def filters(year: int | None = None, department: str | None = None, family: str | None = None, low: float | None = None, high: float | None = None, single_bid: bool = False) -> Column:
    """Conjunction of the filters that are given; a filter left out is skipped."""
    if low is not None and high is not None and low > high:
        raise ValueError("the least amount is above the largest")
    ok = F.lit(True)
    if year is not None:
        ok = ok & (F.col("annee") == year)
    if department is not None:
        ok = ok & (F.col("acheteur_departement_code") == department)
    if family is not None:
        ok = ok & (F.col("famille_cpv") == family)
    if low is not None:
        ok = ok & (F.col("montant") >= low)
    if high is not None:
        ok = ok & (F.col("montant") <= high)
    if single_bid:
        ok = ok & F.coalesce(F.col("offre_unique"), F.lit(False))
    return ok


def vocabulary(df: DataFrame, words: str, share: float = 1.0, seed: int = 42) -> DataFrame:
    """(lexeme, marches, echantillon): document frequencies on a sample (the whole if ``share`` is 1)."""
    x = df if share >= 1 else df.sample(share, seed)
    n = x.agg(F.count(F.lit(1)).alias("echantillon"))
    f = x.select(F.explode(F.array_distinct(words)).alias("lexeme")).groupBy("lexeme").agg(F.count(F.lit(1)).alias("marches"))
    return f.crossJoin(F.broadcast(n))
