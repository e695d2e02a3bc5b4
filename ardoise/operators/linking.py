"""Linking notices to contracts by equal buyer, a band of dates and text similarity: the level funnel.

Levels: 0 the buyer is unknown, 1 the buyer is known, 2 a contract lies in the window of dates,
3 its text is similar enough, 4 its supplier is named in the notice (which takes precedence over 3).
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ardoise.functions.columns import half_up
from ardoise.functions.text import fold
from ardoise.session import materialise

BEFORE, AFTER = 90, 540
SIMILAR = 0.6
# A buyer with more pairs of notices and contracts is cut into spans of so many days; contracts of one group for Python; texts compared at a time.
BUYER_PAIRS, SPAN_DAYS, GROUP_CONTRACTS, TEXTS = 5_000_000, 180, 20_000, 4_096


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(fold(c), F.lit("")), " "), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def candidates(notices: DataFrame, contracts: DataFrame, after: int = AFTER, before: int = BEFORE) -> DataFrame:
    """Equal folded buyer names and a band of dates: an equi-join with a range residual."""
    n = notices.select("idweb", fold(F.col("acheteur_nom")).alias("_a"), F.col("date_parution").alias("_p"), words(F.col("objet_boamp")).alias("_mn"), fold(F.col("titulaire_nom")).alias("_tn"))
    c = contracts.filter("date_notification between '2010-01-01' and '2030-12-31'").select(F.col("id"), fold(F.col("acheteur_nom")).alias("_b"), F.col("date_notification").alias("_d"), words(F.col("objet")).alias("_mc"), fold(F.col("titulaire_nom")).alias("_tc"))
    on = (F.col("_a") == F.col("_b")) & F.col("_d").between(F.date_sub("_p", before), F.date_add("_p", after))
    x = n.join(c, on)
    return x.select("idweb", "id", F.datediff("_d", "_p").alias("jours"), F.round(jaccard(F.col("_mn"), F.col("_mc")), 6).alias("similarite"), F.coalesce(F.col("_tn") == F.col("_tc"), F.lit(False)).alias("titulaire"))


def levels(notices: DataFrame, contracts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(idweb, niveau, similarite, candidats) of every notice."""
    one = notices.filter("idweb is not null").dropDuplicates(["idweb"])
    buyers = contracts.select(fold(F.col("acheteur_nom")).alias("_b")).filter("_b is not null").distinct()
    known = one.select("idweb", fold(F.col("acheteur_nom")).alias("_b")).join(buyers, "_b", "left_semi").select("idweb", F.lit(True).alias("_connu"))
    best = candidates(one, contracts).groupBy("idweb").agg(F.max("similarite").alias("similarite"), F.max("titulaire").alias("_t"), F.count(F.lit(1)).alias("candidats"))
    x = one.select("idweb").join(known, "idweb", "left").join(best, "idweb", "left")
    level = F.when(F.col("_t"), 4).when(F.col("similarite") > similar, 3).when(F.col("candidats") > 0, 2).when(F.col("_connu"), 1).otherwise(0)
    return x.select("idweb", level.alias("niveau"), "similarite", F.coalesce("candidats", F.lit(0)).alias("candidats"))


def funnel(x: DataFrame) -> DataFrame:
    """How many notices reach at least each level."""
    one = x.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("niveau") >= k).alias(f"n{k}") for k in range(5)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("niveau"), F.col(f"n{k}").alias("avis"), half_up(F.try_divide(F.lit(100.0) * F.col(f"n{k}"), F.col("_n")), 2).alias("part")) for k in range(5)])))


def sweep(notices: DataFrame, contracts: DataFrame, windows: list[int], thresholds: list[float]) -> DataFrame:
    """Notices linked for each window and threshold: similarity is computed once, at the widest window."""
    x = candidates(notices.filter("idweb is not null").dropDuplicates(["idweb"]), contracts, after=max(windows))
    best = x.groupBy("idweb").agg(*[F.max(F.when(F.col("jours") <= w, F.col("similarite"))).alias(f"w{w}") for w in windows])
    cells = [(w, t) for w in windows for t in thresholds]
    one = best.agg(*[F.count_if(F.col(f"w{w}") > t).alias(f"c{i}") for i, (w, t) in enumerate(cells)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(w).alias("fenetre"), F.lit(t).alias("seuil"), F.col(f"c{i}").alias("lies")) for i, (w, t) in enumerate(cells)])))


def stratified(x: DataFrame, per_band: int = 12) -> DataFrame:
    """At most ``per_band`` notices of each tenth of similarity from 0.4 up, in order of their identifier: a sample to be judged by hand."""
    band = F.floor(F.least(F.round(F.col("similarite") * 10, 6), F.lit(9.0)))
    y = x.filter("similarite >= 0.4").withColumn("bande", band.cast("int"))
    return y.withColumn("_k", F.row_number().over(Window.partitionBy("bande").orderBy("idweb"))).filter(F.col("_k") <= per_band).select("bande", "idweb", "similarite")


def difflib_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``ratio``: Ratcliff-Obershelp similarity of two text columns, null if either is."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(ratio=[None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(pdf[a], pdf[b])])

    return df.mapInPandas(add, f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, ratio double")


LETTERS, CODES, WORD = 128, 1 << 16, 64


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _letter_counts(texts: list[str]) -> np.ndarray:
    """How often each class of letters stands in each text; letters that share a class only raise what is common."""
    n, sizes = len(texts), [len(t) for t in texts]
    kind = np.uint32 if max(sizes, default=0) >= 1 << 16 else np.uint16
    at = np.repeat(np.arange(n), sizes) + (_codes("".join(texts)) % LETTERS).astype(np.int64) * n
    return np.bincount(at, minlength=LETTERS * n).reshape(LETTERS, n).astype(kind)


def common_subsequence(a: str, texts: list[str], table: np.ndarray | None = None) -> np.ndarray:
    """At least the length of the longest common subsequence of ``a`` with each text: bit-parallel, all texts at once."""
    table = np.zeros(CODES, np.uint64) if table is None else table
    letters = _codes(a) % CODES
    columns = (np.array(texts, dtype=f"U{max(1, *map(len, texts))}").view(np.uint32).reshape(len(texts), -1) % CODES).T
    masks, rows = [], [np.full(len(texts), np.iinfo(np.uint64).max, np.uint64) for _ in range(0, len(a), WORD)]
    for k in range(len(rows)):
        part = letters[k * WORD : (k + 1) * WORD]
        np.bitwise_or.at(table, part, np.uint64(1) << np.arange(len(part), dtype=np.uint64))
        masks.append(table[columns])
        table[part] = 0
    for j in range(len(columns)):
        carry = None
        for k, row in enumerate(rows):
            hit = row & masks[k][j]
            added = row + hit
            over = added < hit
            if carry is not None:
                added = added + carry
                over |= added < carry
            rows[k] = added | (row - hit)
            carry = over.astype(np.uint64) if k + 1 < len(rows) else None
    out = np.zeros(len(texts), np.int64)
    for k, row in enumerate(rows):
        size = min(WORD, len(a) - k * WORD)
        out += size - np.bitwise_count(row & np.uint64((1 << size) - 1)).astype(np.int64)
    return out


def _best_of_buyer(notices: list[tuple[str, int, str]], contracts: list[tuple[int, int, str]], table: np.ndarray) -> Iterator[tuple[str, int, float]]:
    """The most similar contract of each notice (idweb, day, text) among those (day, id, text) of its band of days.

    The ratio never exceeds that of the letters in common, nor that of the longest common subsequence.
    Texts are taken from the highest bound down; those whose bound lies under the best ratio are passed over.
    """
    contracts.sort()
    days, ids, texts = np.array([c[0] for c in contracts]), [c[1] for c in contracts], [c[2] for c in contracts]
    counts, sizes = _letter_counts(texts), np.array([len(t) for t in texts])
    for idweb, day, text in notices:
        first, last = np.searchsorted(days, [day - BEFORE, day + AFTER + 1])
        if first >= last:
            continue
        letters, often = np.unique(_codes(text) % LETTERS, return_counts=True)
        common = np.zeros(last - first, counts.dtype)
        for c, n in zip(letters, often, strict=True):
            common += np.minimum(counts[c, first:last], counts.dtype.type(n))
        whole = sizes[first:last] + len(text)
        ratio = lambda m, w: np.where(w > 0, 2.0 * m / np.maximum(w, 1), 1.0)
        bound = ratio(common, whole)
        best, matcher, many = (-1.0, 0), SequenceMatcher(None, text, ""), TEXTS // 64
        left = np.arange(last - first)
        while len(left):
            if len(left) > many:
                left = left[np.argpartition(-bound[left], many - 1)[:many]]
            # Equal texts are compared once, with the smallest of their ids.
            smallest: dict[str, int] = {}
            for k in left:
                t, i = texts[first + k], ids[first + k]
                smallest[t] = min(i, smallest.get(t, i))
            bound[left], distinct = -2.0, list(smallest)
            closer = ratio(common_subsequence(text, distinct, table), np.array([len(t) for t in distinct]) + len(text))
            for k in np.argsort(-closer, kind="stable"):
                if closer[k] < best[0]:
                    break
                matcher.set_seq2(distinct[k])
                best = max(best, (matcher.ratio(), -smallest[distinct[k]]))
            left, many = np.nonzero(bound >= best[0])[0], TEXTS
        yield idweb, -best[1], best[0]


def _best_of_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """All buyers and spans of a group, told apart here."""
    parts: dict[tuple, tuple[list, list]] = {}
    for buyer, span, idweb, ident, day, text in zip(pdf["_b"], pdf["_part"], pdf["idweb"], pdf["id"], pdf["_jour"], pdf["_texte"], strict=True):
        own = parts.setdefault((buyer, span), ([], []))
        if idweb is None:
            own[1].append((day, int(ident), text))
        else:
            own[0].append((idweb, day, text))
    table = np.zeros(CODES, np.uint64)
    return pd.DataFrame([x for n, c in parts.values() if n and c for x in _best_of_buyer(n, c, table)], columns=["idweb", "id", "ratio"])


def most_similar(notices: DataFrame, contracts: DataFrame) -> DataFrame:
    """(idweb, id, ratio): of every notice the contract of the band join with the highest Ratcliff-Obershelp ratio of the subjects; of equal ones the smaller id.

    Every pair of the band join is held against bounds, so the result is that of comparing them all.
    """
    day = lambda c: F.unix_date(c)
    n = notices.select(fold(F.col("acheteur_nom")).alias("_b"), "idweb", day("date_parution").alias("_jour"), F.col("objet_boamp").alias("_texte")).dropna()
    c = contracts.filter("date_notification between '2010-01-01' and '2030-12-31'").select(fold(F.col("acheteur_nom")).alias("_b"), "id", day("date_notification").alias("_jour"), F.col("objet").alias("_texte")).dropna()
    # Versions of one award say the same on the same day.
    n, c = materialise(n, "avis-a-lier"), materialise(c.groupBy("_b", "_jour", "_texte").agg(F.min("id").alias("id")), "marches-a-lier")
    count = lambda df, name: df.groupBy("_b").agg(F.count(F.lit(1)).alias(name))
    both = count(n, "_n").join(count(c, "_c"), "_b")
    sizes = materialise(both.select("_b", "_c", (F.col("_n") * F.col("_c") > BUYER_PAIRS).alias("_grand")), "acheteurs-a-lier")
    span = lambda shift: F.floor((F.col("_jour") + shift) / F.lit(SPAN_DAYS))
    n = n.join(sizes, "_b").select("_b", F.when(F.col("_grand"), span(0)).otherwise(0).alias("_part"), "idweb", F.lit(None).cast("long").alias("id"), "_jour", "_texte")
    c = c.join(sizes, "_b").select("_b", F.explode(F.when(F.col("_grand"), F.sequence(span(-AFTER), span(BEFORE))).otherwise(F.array(F.lit(0).cast("long")))).alias("_part"), F.lit(None).cast("string").alias("idweb"), "id", "_jour", "_texte")
    groups = max(48, -(-(sizes.agg(F.sum("_c")).first()[0] or 0) // GROUP_CONTRACTS))
    x = n.unionByName(c).withColumn("_groupe", F.pmod(F.xxhash64("_b", "_part"), F.lit(groups))).repartition(groups, "_groupe")
    return x.groupBy("_groupe").applyInPandas(_best_of_group, "idweb string, id long, ratio double")


def verdict_table(verdicts: DataFrame) -> DataFrame:
    """Verdicts crossed by band with fixed columns, and the share judged right, doubts left out."""
    p = verdicts.groupBy("tranche").pivot("verdict_humain", ["oui", "non", "doute"]).agg(F.count(F.lit(1))).na.fill(0)
    return p.select("tranche", "oui", "non", "doute", half_up(F.try_divide(F.lit(100.0) * F.col("oui"), (F.col("oui") + F.col("non")).cast("double")), 4).alias("justesse"))


def decision_table(verdicts: DataFrame) -> DataFrame:
    """For each lower bound of similarity: how many pairs lie above, and how many are expected right by the bands' accuracy."""
    v = verdict_table(verdicts).withColumn("borne", F.substring("tranche", 1, 3).cast("double")).withColumn("taille", F.col("oui") + F.col("non") + F.col("doute"))
    w = Window.orderBy(F.desc("borne")).rowsBetween(Window.unboundedPreceding, 0)  # one row a band: ten at most
    return v.select("borne", F.sum("taille").over(w).alias("paires"), half_up(F.sum(F.col("taille") * F.coalesce("justesse", F.lit(0.0)) / 100).over(w), 2).alias("attendues_justes"))
