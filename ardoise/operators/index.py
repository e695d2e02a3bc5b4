"""An inverted index over weighted texts: stored postings by lexeme, read instead of the texts.

One row of the postings is one lexeme of one field weight of one document, with its positions and the
length of the document.  The table is written once to the shared folder, in ranges of (lexeme, id) and
sorted, so that a search reads only the row groups of its own words, and a lexeme that is in a third
of all documents spreads over as many files as its postings need.  A later search over the same files
finds the table again; files that changed give another.

Defined results: a null or empty text has no postings; repeated rows have postings of their own if
their ids differ; a search without words finds nothing; empty tables give empty postings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ardoise.functions.snowball import stem, stems
from ardoise.operators.search import CAP, WEIGHTS, Query, cover_density, tokens
from ardoise.session import BROADCAST_ROWS, keep, materialise, shared_folder

# Postings of one file, at most about so many.
FILE_POSTINGS = 4_000_000
SCHEMAS = ("lexeme string, poids string, id long, longueur int, positions array<int>", "lexeme string, poids string, marches long", "poids string, documents long, mots long")


@dataclass(frozen=True)
class Index:
    """postings: lexeme, poids, id, longueur, positions.  vocabulary: lexeme, poids, marches.  totals: poids, documents, mots."""

    postings: DataFrame
    vocabulary: DataFrame
    totals: DataFrame

    def of(self, lexemes: list[str], weights: str = "ABCD") -> DataFrame:
        x = self.postings.filter(F.col("lexeme").isin(lexemes))
        return x if weights == "ABCD" else x.filter(F.col("poids").isin(list(weights)))


def lexemes(terms: list[str] | tuple[str, ...]) -> list[str]:
    """The distinct stems of folded words, in order."""
    return list(dict.fromkeys(stem(t) for t in terms))


def _postings(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """df: id and the texts of ``fields`` (column, weight); positions run on from one field to the next."""
    x = df.select("id", *[tokens(F.col(c)).alias(f"_t{k}") for k, (c, _) in enumerate(fields)])
    x = x.select("id", *[stems(F.col(f"_t{k}")).alias(f"_t{k}") for k in range(len(fields))])
    offset, by_weight = F.lit(0), {}
    for k, (_, weight) in enumerate(fields):
        words = F.col(f"_t{k}")
        by_weight.setdefault(weight, []).append(_placed(words, offset))
        offset = offset + F.size(words)

    def entries(weight: str, placed: Column) -> Column:
        one = lambda lex: F.struct(lex.alias("lexeme"), F.lit(weight).alias("poids"), F.size(placed).alias("longueur"), F.transform(F.filter(placed, lambda e: e["m"] == lex), lambda e: e["p"]).alias("positions"))
        return F.transform(F.array_distinct(F.transform(placed, lambda e: e["m"])), one)

    every = F.concat(*[entries(w, F.concat(*parts)) for w, parts in by_weight.items()])
    return x.select("id", F.inline(every)).select("lexeme", "poids", "id", "longueur", "positions")


def _placed(words: Column, start: Column) -> Column:
    return F.transform(words, lambda w, i: F.struct(w.alias("m"), (i + 1 + start).cast("int").alias("p")))


def _fingerprint(df: DataFrame, fields: list[tuple[str, str]]) -> str:
    """Of the files behind a frame (names, sizes, times) and of what is indexed of it."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    h = hashlib.sha256(repr(fields).encode())
    for name in sorted(df.inputFiles()):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        s = p.getFileSystem(conf).getFileStatus(p)
        h.update(f"{name} {s.getLen()} {s.getModificationTime()}".encode())
    return h.hexdigest()[:32]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def index(df: DataFrame, fields: list[tuple[str, str]], name: str) -> Index:
    """The index of the texts of a frame that is read from files: found again, or built."""
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/index-{name}-{_fingerprint(df, fields)}"
    paths = [f"{base}/{part}" for part in ("postings", "vocabulary", "totals")]
    if not _exists(spark, paths[2]):
        keep(spark, base)
        x = _postings(df, fields)
        files = max(1, -(-df.count() * 12 // FILE_POSTINGS))
        x.repartitionByRange(files, "lexeme", "id").sortWithinPartitions("lexeme", "id").write.mode("overwrite").parquet(paths[0])
        written = spark.read.parquet(paths[0])
        written.groupBy("lexeme", "poids").agg(F.count(F.lit(1)).alias("marches")).sort("lexeme").write.mode("overwrite").parquet(paths[1])
        lengths = {w: sum((F.size(tokens(F.col(c))) for c, v in fields if v == w), F.lit(0)) for _, w in fields}
        size = F.array(*[F.struct(F.lit(w).alias("poids"), n.cast("long").alias("mots")) for w, n in lengths.items()])
        df.select(F.inline(size)).groupBy("poids").agg(F.count(F.lit(1)).alias("documents"), F.sum("mots").alias("mots")).coalesce(1).write.mode("overwrite").parquet(paths[2])
    return Index(*[spark.read.schema(schema).parquet(p) for schema, p in zip(SCHEMAS, paths, strict=True)])


def having_all(ix: Index, terms: list[str], weights: str = "ABCD") -> DataFrame:
    """(id): documents with every word."""
    wanted = lexemes(terms)
    if not wanted:
        return ix.postings.select("id").limit(0)
    if len(wanted) == 1:
        found = ix.of(wanted, weights).select("id")
        return found if len(weights) == 1 else found.distinct()
    return ix.of(wanted, weights).groupBy("id").agg(F.count_distinct("lexeme").alias("_n")).filter(F.col("_n") == len(wanted)).select("id")


def having_any(ix: Index, terms: list[str], weights: str = "ABCD") -> DataFrame:
    """(id): documents with at least one word."""
    return ix.of(lexemes(terms), weights).select("id").distinct()


def cascade(ix: Index, terms: list[str], weights: str = "ABCD") -> DataFrame:
    """(id, mode): all words first; any word only where nothing has them all."""
    both = having_all(ix, terms, weights).withColumn("mode", F.lit("et"))
    none = both.limit(1).agg((F.count(F.lit(1)) == 0).alias("_vide"))
    either = having_any(ix, terms, weights).crossJoin(F.broadcast(none)).filter("_vide").select("id", F.lit("ou").alias("mode"))
    return both.unionByName(either)


def web(ix: Index, q: Query, weights: str = "ABCD") -> DataFrame:
    """(id): what a web-style question asks for; a question without words finds nothing."""
    needed = [[stem(w)] for w in q.all] + [lexemes(g) for g in q.any] + [[stem(w)] for p in q.phrases for w in p]
    if not needed:
        return ix.postings.select("id").limit(0)
    barred = lexemes(q.none)
    words = list(dict.fromkeys([w for g in needed for w in g] + barred))
    held = ix.of(words, weights).groupBy("id").agg(F.collect_list(F.struct("lexeme", "positions")).alias("_p"))
    has = lambda w: F.exists("_p", lambda e: e["lexeme"] == w)
    at = lambda w: F.flatten(F.transform(F.filter("_p", lambda e: e["lexeme"] == w), lambda e: e["positions"]))
    ok = F.lit(True)
    for group in needed:
        any_of = F.lit(False)
        for w in group:
            any_of = any_of | has(w)
        ok = ok & any_of
    for w in barred:
        ok = ok & ~has(w)
    for p in q.phrases:
        ok = ok & F.exists(at(stem(p[0])), _follows([at(stem(w)) for w in p[1:]]))
    return held.filter(ok).select("id")


def _follows(rest: list[Column]):
    def test(start: Column) -> Column:
        ok = F.lit(True)
        for k, places in enumerate(rest, 1):
            ok = ok & F.array_contains(places, start + k)
        return ok

    return test


def bm25(ix: Index, terms: list[str], weight: str = "A", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): BM25 over one field, of every document with one of the words."""
    wanted = lexemes(terms)
    held = ix.of(wanted, weight)
    # At most one row a word, and one in all.
    known = ix.vocabulary.filter(F.col("lexeme").isin(wanted) & (F.col("poids") == weight)).select("lexeme", F.col("marches").alias("_df")).limit(max(1, len(wanted)))
    total = ix.totals.filter(F.col("poids") == weight).agg(F.first("documents").alias("_n"), F.first(F.col("mots") / F.col("documents")).alias("_l"))
    x = held.join(F.broadcast(known), "lexeme").crossJoin(F.broadcast(total))
    tf, idf = F.size("positions"), F.log((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1.0)
    return x.groupBy("id").agg(F.sum(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("longueur") / F.col("_l")))).alias("score"))


def densities(ix: Index, terms: list[str], within: DataFrame | None = None) -> DataFrame:
    """(id, score): cover density with field weights, of documents that have every word; only their postings leave the JVM.

    within: the ids to rank, few enough to be broadcast; all if not given.
    """
    wanted = lexemes(terms)
    found = ix.of(wanted) if within is None else ix.of(wanted).join(F.broadcast(within), "id")
    held = found.groupBy("id").agg(F.collect_list(F.struct("lexeme", "poids", "positions")).alias("_p"), F.count_distinct("lexeme").alias("_n")).filter((F.col("_n") == len(wanted)) & F.lit(bool(wanted))).select("id", "_p")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [cover_density([(int(at), e["lexeme"], WEIGHTS[e["poids"]]) for e in doc for at in e["positions"]], wanted) for doc in pdf["_p"]]
            yield pd.DataFrame({"id": pdf["id"], "score": pd.Series(rows, dtype="float64")})

    return held.mapInPandas(score, "id long, score double")


def bounded_ranking(ix: Index, df: DataFrame, terms: list[str], weights: str = "A", cap: int = CAP) -> DataFrame:
    """At most ``cap`` most recent matches in the order of their cover density, with how many were examined and whether the cap was reached.

    The cap is the feature: a declared approximate ranking, as its columns say.  Equal scores follow
    the amount, largest first, then the id, as in the serving database.
    """
    held = rows_of(df, having_all(ix, terms, weights)).orderBy(F.desc_nulls_last("date_notification"), F.desc("id")).limit(cap)
    # At most cap rows from here on.
    held = materialise(held, "candidats")
    x = held.join(densities(ix, terms, held.select("id")), "id")
    w = Window.partitionBy()
    x = x.withColumn("candidats_examines", F.count(F.lit(1)).over(w)).withColumn("classement_approche", F.col("candidats_examines") >= cap)
    order = [F.desc("score"), F.desc_nulls_last("montant"), F.col("id")]
    return x.withColumn("rang", F.row_number().over(w.orderBy(*order))).orderBy("rang")


def frequencies(ix: Index, weight: str = "A") -> DataFrame:
    """(lexeme, marches, echantillon): document frequency of every lexeme of a field."""
    total = ix.totals.filter(F.col("poids") == weight).agg(F.first("documents").alias("echantillon"))
    return ix.vocabulary.filter(F.col("poids") == weight).select("lexeme", "marches").crossJoin(F.broadcast(total))


def rows_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a table whose ids were found.  At most BROADCAST_ROWS + 1 ids come to the driver, which sends them out again if that are all."""
    found = ids.limit(BROADCAST_ROWS + 1).toArrow()
    if found.num_rows > BROADCAST_ROWS:
        return df.join(ids, "id")
    return df.join(F.broadcast(df.sparkSession.createDataFrame(found)), "id")
