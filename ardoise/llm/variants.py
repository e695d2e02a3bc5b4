"""Variant spellings of names typed by people: trie join, then token-order permutations.

1. The distinct names of a field give a vocabulary of words, weighted by rows.
2. A trie join links every word, and every pair of neighbouring words run together, with the words
   within one edit.  A rare word becomes its far commoner neighbour (typing errors), two words
   become one (a space typed inside a word), one word becomes two (a space left out).
3. Names are then read without regard to word order: kind of body, legal form, remaining words.  Of
   the remaining words the *core* is the one seen beside the fewest other words: the town, the
   family name, the firm's own name.
4. Names sharing a core, a kind and compatible details (equal, abbreviated, initials, nickname, or
   left out) are one entity.  A name that fits several entities joins none of them.

Work happens on distinct names and distinct signatures, never on rows, so a name that fills a third
of all rows costs what any other costs.

Defined results: null, empty and letterless names belong to no entity and give no pair; equal names
are one spelling; a name that fits no other gives no pair; empty tables give no row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ardoise.llm import names as N
from ardoise.llm.trie_join import trie_join
from ardoise.session import materialise, shuffled

# A word is a misspelling of its neighbour only if that neighbour is so many times as common.
DOMINANCE = 3.0
# ... or if it is long and stands in so few names that it can't be a word of its own.
LONG, FEW = 8, 4
LEXICON_WEIGHT = 3.0
BUCKET_SIGNATURES = 5_000


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ws = [N.words(x) for x in pdf["nom"]]
        yield pdf.assign(mots=ws, paires=[N.joins(w) for w in ws])


def _canonical_words(ws: list[str], known: dict[str, str]) -> list[str]:
    """Words with misspellings, split words and run-together words resolved by ``known``."""
    out, k = [], 0
    while k < len(ws):
        joined = known.get("+" + ws[k] + ws[k + 1]) if k + 1 < len(ws) else None
        if joined:
            out += known.get(joined, joined).split(" ")
            k += 2
        else:
            out += known.get(ws[k], ws[k]).split(" ")
            k += 1
    return out


def _read_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for champ, nom, n, mots, cles, valeurs in zip(pdf["champ"], pdf["nom"], pdf["n"], pdf["mots"], pdf["cles"], pdf["valeurs"]):
            kind, legal, rest = N.read(_canonical_words(list(mots), dict(zip(cles, valeurs))))
            rows.append((champ, nom, n, kind, legal, sorted(set(rest))))
        yield pd.DataFrame(rows, columns=["champ", "nom", "n", "genre", "forme", "reste"])


def _fuller(sigs: list[tuple[frozenset, str, int]]) -> list[set[int]]:
    """Of each signature, the others that it may stand for."""
    n = len(sigs)
    words = sorted({(w, k) for k, (d, _, _) in enumerate(sigs) for w in d}) if n > 16 else []
    above = []
    for a, (details, form, _) in enumerate(sigs):
        # A word of five letters or more stands only for words that begin with it: those are neighbours in sorted order.
        probe = max((w for w in details if len(w) >= 5), key=len, default=None) if words else None
        others = range(n) if probe is None else {k for _, k in words[bisect_left(words, (probe, -1)) : bisect_left(words, (probe + "\uffff", -1))]}
        above.append({b for b in others if b != a and (not form or form == sigs[b][1]) and N.covers(details, sigs[b][0])})
    return above


def _entities(sigs: list[tuple[frozenset, str, int]]) -> list[int]:
    """The entity of each signature of one (field, core, kind)."""
    above = _fuller(sigs)
    # Signatures that only stand for each other are one; the fullest of them leads.
    full = {a for a in range(len(sigs)) if all(a in above[b] for b in above[a])}
    lead = {a: max((b for b in {a} | above[a] if b in full), key=lambda b: (len(sigs[b][0]), sum(map(len, sigs[b][0])), len(sigs[b][1]), sigs[b][2], -b)) for a in full}
    out = []
    for a in range(len(sigs)):
        seeds = {lead[a]} if a in lead else {lead[b] for b in above[a] if b in lead}
        out.append(min(seeds) if len(seeds) == 1 else len(sigs) + a)
    return out


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """The entity of each signature; a bucket holds many cores with their kinds, told apart here."""
    groups: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(pdf["champ"], pdf["noyau"], pdf["genre"], strict=True)):
        groups.setdefault(key, []).append(k)
    details, forms, weights = [frozenset(d) for d in pdf["details"]], pdf["forme"].tolist(), pdf["poids"].tolist()
    out = [0] * len(pdf)
    for rows in groups.values():
        # In a stated order, so that the result does not hang on how rows arrive.
        rows.sort(key=lambda k: (sorted(details[k]), forms[k]))
        for k, entity in zip(rows, _entities([(details[k], forms[k], weights[k]) for k in rows]), strict=True):
            out[k] = entity
    return pdf[["champ", "noyau", "genre", "forme", "details"]].assign(entite=out)


def canonical_vocabulary(names: DataFrame) -> DataFrame:
    """(champ, cle, valeur): words to replace, by what.  A key ``+ab`` is two neighbouring words run together.

    names: champ, nom, n, mots, paires.
    """
    one = names.select("champ", "n", F.explode("mots").alias("mot")).groupBy("champ", "mot").agg(F.sum("n").cast("double").alias("poids"), F.count(F.lit(1)).alias("dans"))
    pair = names.select("champ", "n", F.explode(F.arrays_zip(F.expr("slice(mots, 1, greatest(size(mots) - 1, 0))").alias("a"), F.expr("slice(mots, 2, size(mots))").alias("b"))).alias("p"), ).select("champ", "n", "p.*")
    pair = pair.groupBy("champ", "a", "b").agg(F.sum("n").cast("double").alias("poids_paire"), F.count(F.lit(1)).alias("dans"))
    fixed = names.select("champ").distinct().withColumn("mot", F.explode(F.array(*[F.lit(w) for w in sorted(N.LEXICON)])))
    vocabulary = materialise(fixed.join(one, ["champ", "mot"], "full").select("champ", "mot", F.coalesce("poids", F.lit(LEXICON_WEIGHT)).alias("poids"), F.coalesce("dans", F.lit(0)).alias("dans"), F.col("mot").isin(*sorted(N.LEXICON)).alias("fixe")), "vocabulaire")
    pairs = materialise(pair.withColumn("mot", F.concat("a", "b")), "paires")
    # Words are held against words and pairs, pairs against words only.
    words, pair_words, rare = vocabulary.select("champ", "mot"), pairs.select("champ", "mot"), vocabulary.filter(~F.col("fixe")).select("champ", "mot")

    def sides(first: DataFrame, second: DataFrame) -> DataFrame:
        tag = lambda df, k: df.select(F.concat_ws("|", "champ", F.lit(k)).alias("groupe"), "mot")
        return tag(first, "mot").unionByName(tag(second, "paire"))

    near = trie_join(sides(words.unionByName(pair_words), words), sides(rare, pair_words))
    near = materialise(near.select(F.substring_index("groupe", "|", 1).alias("champ"), F.substring_index("groupe", "|", -1).alias("sorte"), "sonde", "mot", "distance"), "voisins")
    of_words, of_pairs = near.filter("sorte = 'mot'"), near.filter("sorte = 'paire'")

    weight = shuffled(vocabulary.select("champ", F.col("mot"), F.col("poids").alias("poids_mot")))
    own = shuffled(vocabulary.filter(~F.col("fixe")).select("champ", F.col("mot").alias("sonde"), F.col("poids").alias("poids_sonde"), "dans"))
    clear = F.col("poids_mot") >= DOMINANCE * F.col("poids_sonde")
    slip = (F.length("sonde") >= LONG) & (F.col("dans") <= FEW)
    heavier = (F.col("poids_mot") > F.col("poids_sonde")) | ((F.col("poids_mot") == F.col("poids_sonde")) & (F.col("mot") < F.col("sonde")))
    # One word for one word.
    word = of_words.filter("distance > 0").join(own, ["champ", "sonde"]).join(weight, ["champ", "mot"]).filter(clear | (slip & heavier))
    best = Window.partitionBy("champ", "sonde").orderBy(F.col("distance"), F.col("poids_mot").desc(), F.col("mot"))
    word = word.withColumn("_k", F.row_number().over(best)).filter("_k = 1").select("champ", "sonde", "mot", F.lit(1).alias("ordre"))
    # A misspelling of a misspelling follows on to the word itself.
    onward = shuffled(word.select("champ", F.col("sonde").alias("mot"), F.col("mot").alias("mot2")))
    for _ in range(2):
        word = word.join(onward, ["champ", "mot"], "left").select("champ", "sonde", F.coalesce("mot2", "mot").alias("mot"), "ordre")
    # One word for two: the word is, but for one edit, a known pair run together.
    two = of_words.join(own, ["champ", "sonde"]).join(shuffled(pairs.select("champ", "mot", "a", "b", F.col("poids_paire").alias("poids_mot"))), ["champ", "mot"]).filter(clear & (F.length("sonde") >= 6))
    best = Window.partitionBy("champ", "sonde").orderBy(F.col("distance"), F.col("poids_mot").desc(), F.col("a"))
    two = two.withColumn("_k", F.row_number().over(best)).filter("_k = 1").select("champ", "sonde", F.concat_ws(" ", "a", "b").alias("mot"), F.lit(2).alias("ordre"))
    single = word.unionByName(two)
    best = Window.partitionBy("champ", "sonde").orderBy("ordre")
    single = single.withColumn("_k", F.row_number().over(best)).filter("_k = 1").select("champ", F.col("sonde").alias("cle"), F.col("mot").alias("valeur"))
    # Two words for one: the pair run together is, but for one edit, a word far commoner than its rarer half.
    halves = pairs.join(weight.select("champ", F.col("mot").alias("a"), F.col("poids_mot").alias("poids_a")), ["champ", "a"]).join(weight.select("champ", F.col("mot").alias("b"), F.col("poids_mot").alias("poids_b")), ["champ", "b"])
    halves = halves.select("champ", F.col("mot").alias("sonde"), F.least("poids_a", "poids_b", "poids_paire").alias("poids_sonde"), "dans", "a", "b")
    joined = of_pairs.join(shuffled(halves), ["champ", "sonde"]).join(weight, ["champ", "mot"]).filter((clear | (slip & heavier)) & (F.length("mot") >= 5))
    # An initial beside a word is no part of it, unless the two are exactly a known word.
    joined = joined.filter((F.col("mot") != F.col("a")) & (F.col("mot") != F.col("b")) & ((F.col("distance") == 0) | (F.least(F.length("a"), F.length("b")) > 1)))
    best = Window.partitionBy("champ", "sonde").orderBy(F.col("distance"), F.col("poids_mot").desc(), F.col("mot"))
    joined = joined.withColumn("_k", F.row_number().over(best)).filter("_k = 1").select("champ", F.concat(F.lit("+"), "sonde").alias("cle"), F.col("mot").alias("valeur"))
    return single.unionByName(joined)


def spellings(fields: DataFrame) -> DataFrame:
    """(champ, nom, entite): every distinct name with the entity it belongs to.

    fields: champ string, nom string, one row per occurrence.
    """
    distinct = fields.filter(F.col("nom").isNotNull()).groupBy("champ", "nom").agg(F.count(F.lit(1)).alias("n"))
    names = materialise(distinct.mapInPandas(_tokenise, "champ string, nom string, n long, mots array<string>, paires array<string>").filter(F.size("mots") > 0), "noms")
    known = canonical_vocabulary(names)
    terms = names.select("champ", "nom", F.explode(F.array_distinct(F.concat("mots", F.transform("paires", lambda p: F.concat(F.lit("+"), p))))).alias("cle"))
    maps = terms.join(shuffled(known), ["champ", "cle"]).groupBy("champ", "nom").agg(F.collect_list("cle").alias("cles"), F.collect_list("valeur").alias("valeurs"))
    empty = F.array().cast("array<string>")
    read = names.join(shuffled(maps), ["champ", "nom"], "left").select("champ", "nom", "n", "mots", F.coalesce("cles", empty).alias("cles"), F.coalesce("valeurs", empty).alias("valeurs"))
    read = materialise(read.mapInPandas(_read_names, "champ string, nom string, n long, genre string, forme string, reste array<string>"), "lus")

    word = read.select("champ", "nom", "reste", F.explode("reste").alias("mot"))
    beside = word.select("champ", "mot", F.explode("reste").alias("autre")).filter("mot <> autre").groupBy("champ", "mot", "autre").agg(F.lit(1).alias("_1"))
    degree = beside.groupBy("champ", "mot").agg(F.count(F.lit(1)).alias("degre"))
    core = Window.partitionBy("champ", "nom").orderBy(F.coalesce("degre", F.lit(0)) + F.when(F.length("mot") < 4, 1_000_000).otherwise(0), -F.length("mot"), "mot")
    cores = word.join(shuffled(degree), ["champ", "mot"], "left").withColumn("_k", F.row_number().over(core)).filter("_k = 1").select("champ", "nom", F.col("mot").alias("noyau"))
    known_names = materialise(read.join(shuffled(cores), ["champ", "nom"]).withColumn("details", F.array_remove("reste", F.col("noyau"))), "noyaux")
    signatures = known_names.groupBy("champ", "noyau", "genre", "forme", "details").agg(F.sum("n").alias("poids"))
    signatures = materialise(signatures, "signatures")
    # Cores travel in buckets, whose number follows that of the signatures.
    bucket = F.pmod(F.xxhash64("champ", "noyau", "genre"), F.lit(max(16, -(-signatures.count() // BUCKET_SIGNATURES)))).alias("_seau")
    resolved = signatures.groupBy(bucket).applyInPandas(_resolve, "champ string, noyau string, genre string, forme string, details array<string>, entite int")
    x = known_names.join(shuffled(resolved), ["champ", "noyau", "genre", "forme", "details"])
    return x.select("champ", "nom", F.concat_ws("|", "noyau", "genre", F.col("entite").cast("string")).alias("entite"))


def variant_pairs(fields: DataFrame) -> DataFrame:
    """(champ, nom_a, nom_b): each pair of spellings of one entity, nom_a before nom_b in UTF-8 byte order."""
    s = materialise(spellings(fields), "graphies")
    a, b = s.withColumnRenamed("nom", "nom_a"), s.withColumnRenamed("nom", "nom_b")
    return a.join(shuffled(b), ["champ", "entite"]).filter("nom_a < nom_b").select("champ", "nom_a", "nom_b")
