"""Matching notices and contracts that share no key: collective graph linkage.

1. Every record becomes a set of attribute keys that are rare by construction: a rare word of its
   subject (a place, say) with another word, its halves with those of the buyer's own name, or, where
   no place is named, the buyer's name with a word and a month.  A common key makes an edge.  Notices
   that no edge is accepted for are looked for again by every key that their records allow.
2. Meta-blocking: an edge weighs the sum of its shared keys' inverse frequencies; edges lighter than
   a share of the mean weight of their notice are pruned.
3. Each kept edge is judged on every attribute: place, kind of work, subject, buyer, kind of buyer,
   dates, amount on its source's scale, supplier, family.  The judgement is a sum of log-odds.
4. Propagation: what the neighbours of an edge say is added -- the spelling of a buyer or supplier in
   notices that mostly goes with one buyer or supplier in contracts speaks for further edges between
   the two -- and the shares of each notice's edges are computed anew until they no longer move.
5. The confidence is the share of the best edge, calibrated on the pairs judged by hand.

Defined results: a notice delivered twice counts once; rows without identifier or contract number
take no part; missing attributes speak neither for nor against; equal candidates fall to the earlier
date, then the smaller number; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ardoise.functions.text import contract_number, fold
from ardoise.llm import names as N
from ardoise.llm.leaks import FILTER_BITS, bitmap_of
from ardoise.session import materialise, shuffled, small

# A word of a subject is rare if at most this share of the contracts has it.
RARE_SHARE = 0.004
RARE_LEAST = 12
# Of the frequent words, those that this share of the buyers use name things; the others may be places.
BUYERS_SHARE = 0.05
PRUNE = 0.5
# Least share of a notice's best edge to be given out as its contract.
ACCEPT = 0.5
# Propagation ends when no share moves by STILL; it is an error if that takes more than so many rounds.
ROUNDS, STILL, LEAST_STEP = 100, 0.01, 0.125
# Months from a notice to its award that the buyer key covers.
MONTHS = 15
# A word of suppliers' names says a trade if it stands beside this share of all other words, and at least so many.
GENERIC_SHARE, GENERIC_LEAST = 0.004, 30
# A buyer or supplier is common if it holds this share of the contracts.
HOLDER_SHARE = 0.005
# Contracts of one part of a block; distinct keys (one long each) that may be broadcast.
BLOCK_CONTRACTS, KEYS_BROADCAST = 2_000, 500_000
# The labelled pairs that take part in the weights and calibrate the confidence: at most so many.
LABELS, RIDGE = 20_000, 5.0

# Ways of saying one kind of work, folded; the first that occurs counts.
WORK = {
    "maintenance": ["prestation de maintenance", "services de maintenance", "presta maintenance", "entretien", "maintenance"],
    "assistance": ["mission d assistance", "mission assistance", "amo", "accompagnement", "assistance"],
    "location": ["location longue duree", "mise a disposition", "location", "loc"],
    "remplacement": ["remplacement", "renouvellement", "changement", "rempl"],
    "refection": ["travaux de refection", "refection", "renovation", "trvx", "travaux"],
    "fourniture": ["fourniture", "fournitures", "acquisition", "achat", "fourn"],
}
# Words of subjects that name neither the thing nor the place.
SUBJECT_EMPTY = frozenset(
    "de d du des la le les l et en a au aux un une pour par sur avec mp lot programme annuel marche bons commande consultation relative y compris sujetions diverses "
    "site ecole ec residence res quartier qrt rue pole gymnase gym stade complexe sportif hameau ham lieu dit zone avenue place divers".split()
)
_WORK_WORDS = frozenset(w for ways in WORK.values() for s in ways for w in s.split()) | {"services", "prestation", "mission", "presta", "duree", "longue", "disposition", "mise", "travaux"}


def near(a: str, b: str) -> bool:
    """Within one edit (two for long words), swaps of neighbours counting as one."""
    if a == b:
        return True
    bound = 2 if min(len(a), len(b)) >= 10 else 1 if min(len(a), len(b)) >= 5 else 0
    if abs(len(a) - len(b)) > bound or not bound:
        return False
    return _distance(a, b, bound) <= bound


def _distance(a: str, b: str, cap: int) -> int:
    before, row = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
            if before is not None and i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > cap:
            return cap + 1
        before, row = row, new
    return row[-1]


def _without_one(w: str) -> set[str]:
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


class Usual:
    """The usual words of subjects; tells them, and words one slip away from a long one, from names of places."""

    def __init__(self, frequent: list[str]):
        self.words = frozenset(frequent) | SUBJECT_EMPTY | _WORK_WORDS
        self.slips = {v for w in self.words if len(w) >= 5 for v in _without_one(w)}
        self.known: dict[str, bool] = {}

    def __contains__(self, w: str) -> bool:
        if w not in self.known:
            self.known[w] = w in self.words or len(w) >= 5 and not self.slips.isdisjoint(_without_one(w))
        return self.known[w]

    def places(self, words: list[str]) -> list[str]:
        return [w for w in words if len(w) >= 6 and w not in self]


def work_kind(words: list[str]) -> str:
    text = f" {' '.join(words)} "
    for kind, ways in WORK.items():
        if any(f" {w} " in text for w in ways):
            return kind
    for kind, ways in WORK.items():  # misspelt
        heads = [w.split()[-1] for w in ways if len(w.split()[-1]) >= 7]
        if any(near(w, h) for w in words for h in heads if len(w) >= 6):
            return kind
    return ""


def _contracts(marches: DataFrame) -> DataFrame:
    """One record per contract number: its fullest subject, buyer, suppliers, dates, amounts on a common scale."""
    kept = ("objet", "acheteur_nom", "acheteur_commune_nom", "titulaire_nom", "date_notification", "montant", "famille_cpv", "acheteur_siret", "source")
    m = marches.select(*kept, contract_number(F.col("marche_id"), F.col("uid")).alias("_c")).filter(F.col("_c").isNotNull())
    levels = marches.filter("montant > 0").groupBy("source").agg(F.percentile_approx(F.log10("montant"), 0.5, 1000).alias("_niveau"))
    usual = levels.agg(F.percentile_approx("_niveau", 0.5, 1000).alias("_usuel"))
    # Sources that publish in another unit differ by a power of ten.
    levels = small(levels.crossJoin(F.broadcast(usual)).select("source", F.round(F.col("_niveau") - F.col("_usuel")).alias("_echelle")), "echelles")
    m = m.join(levels, "source", "left").withColumn("_log", F.when(F.col("montant") > 0, F.log10("montant") - F.coalesce("_echelle", F.lit(0.0))))
    date = F.when(F.col("date_notification").between("1990-01-01", "2100-01-01"), F.col("date_notification"))
    return m.groupBy(F.col("_c").alias("contrat")).agg(
        F.max_by("objet", F.struct(F.length("objet"), F.col("objet"))).alias("objet"), F.max_by("acheteur_nom", F.struct(F.length("acheteur_nom"), F.col("acheteur_nom"))).alias("acheteur"), F.max("acheteur_commune_nom").alias("commune"),
        F.collect_set(fold(F.col("titulaire_nom"))).alias("titulaires"), F.min(date).alias("date"), F.collect_set(F.round("_log", 2)).alias("montants"), F.max("famille_cpv").alias("famille"), F.max("acheteur_siret").alias("acheteur_id"),
    )


def _notices(avis: DataFrame) -> DataFrame:
    a = avis.filter(F.col("idweb").isNotNull())
    row = F.struct(F.length("objet_boamp").alias("k"), "objet_boamp", "acheteur_nom", "ville", "date_parution", "montant_estime", "famille_cpv", "titulaire_nom")
    one = a.groupBy("idweb").agg(F.max(row).alias("r"))
    return one.select("idweb", F.col("r.objet_boamp").alias("objet"), F.col("r.acheteur_nom").alias("acheteur"), F.col("r.ville").alias("commune"), F.col("r.titulaire_nom").alias("titulaire"), F.col("r.date_parution").alias("date"), F.when(F.col("r.montant_estime") > 0, F.log10("r.montant_estime")).alias("montant"), F.col("r.famille_cpv").alias("famille"))


def _own_names(name: str | None, town: str | None) -> list[str]:
    """The words of a buyer's own name: what is left of it and of its town without kinds and legal forms."""
    rest = set(N.read(N.words(name))[2]) | {w for w in N.words(town) if w not in N.EMPTY}
    return sorted(w for w in rest if len(w) >= 5 and w not in N.LEXICON)


def _firm_words(name: str) -> list[str]:
    return [w for w in N.read(N.words(name))[2] if len(w) >= 5]


READ = "noms array<string>, lieux array<string>, choses array<string>, travail string, genre string, firmes array<string>, colle string, acheteur_colle string, firme_colle string, cles array<bigint>, cles_toutes array<bigint>"
_READ_NAMES = [c.split(" ")[0] for c in READ.split(", ")]
_SKIP = SUBJECT_EMPTY | _WORK_WORDS


def _halves(w: str) -> tuple[str, str]:
    return "<" + w[:6], ">" + w[-6:]


def _with_things(heads: list[tuple[str, str]], common: list[str]) -> list[str]:
    """Each head, made of a word, with the beginning and the end of every other word."""
    return [k for head, of in heads for v in common if v != of for k in (f"{head}+{v[:4]}", f"{head}+{v[-4:]}$")]


def _dated(words: list[str], common: list[str], when: list[str]) -> list[str]:
    return [f"{h}{v[:5]}{m}" for w in words for h in _halves(w) for v in common for m in when]


def keys_of(words: list[str], places: list[str], names: list[str], firms: list[str], month: int | None, work: str, ahead: int, notice: bool, narrow: bool) -> np.ndarray:
    """The rare attribute keys of one record, hashed.

    A place goes with the beginning of another word of the subject where it is spelt alike, and its
    halves go with those of the buyer's name where either is misspelt.  A record is also looked for by
    its buyer or its supplier, a word of its subject, its kind of work and the months that follow (of a
    notice, by the supplier only without a buyer), and by the halves of its place and a word; if narrow,
    by the buyer or supplier only without a place, by halves and a word only without a buyer.  A record
    whose kind of work is not known is looked for under every kind.
    """
    common = [w for w in dict.fromkeys(words) if len(w) >= 4 and w not in _SKIP]
    keys = _with_things([(r, r) for r in places], common)
    keys += [f"{h}|{k}" for r in places for h in _halves(r) for b in names for k in _halves(b)]
    if not (narrow and names):
        keys += _with_things([(h, r) for r in places for h in _halves(r)], common)
    if month is not None and not (narrow and places):
        when = [f"{m}{k}" for k in ([work] if work else WORK) for m in range(month, month + ahead + 1)]
        keys += _dated(names, common, when)
        if not (notice and names):
            keys += _dated(firms, common, when)
    hashed = set(map(xxhash.xxh3_64_intdigest, keys))
    return np.fromiter(hashed, np.uint64, len(hashed)).view(np.int64)


def _lists(keys: list[np.ndarray], wanted: np.ndarray | None) -> pa.Array:
    """One list of keys a record; of those, only the ones whose bit is set in ``wanted``, if given."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    flat = np.concatenate([np.empty(0, np.int64), *keys])
    if wanted is not None:
        at = flat.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
        kept = (wanted[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        sizes, flat = np.bincount(np.repeat(np.arange(len(keys)), sizes)[kept], minlength=len(keys)), flat[kept]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int64()))


def _read_records(frequent: list[str], things: list[str], generic: list[str], ahead: int | None = None, wanted: Broadcast | None = None):
    """Reads each record once: its buyer's own names and kind, places, thing, kind of work, its suppliers' own words, and its keys.

    ahead: the months that the keys of a notice reach; None for contracts, which have one set of keys.
    wanted: a bitmap of the keys that notices have; others are left out, for they make no edge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind, firm, bits = cache(_own_names), cache(lambda s: N.read(N.words(s))[0]), cache(_firm_words), None if wanted is None else wanted.value
        squeeze, rare, usual, common, trades = cache(lambda s: "".join(N.words(s))), Usual(frequent), Usual(things), frozenset(frequent), frozenset(generic)
        of_things = frozenset(w for w in things if len(w) >= 4 and w not in _SKIP)
        texts, words_ = pa.string(), pa.list_(pa.string())
        types = [words_, words_, words_, texts, texts, words_, texts, texts, texts]
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("mots", "acheteur", "commune", "titulaires", "mois")]
            rows, narrow, every = [], [], []
            for mots, acheteur, commune, titulaires, month in zip(*columns, strict=True):
                firms = [t for t in titulaires if t]
                thing = [w for w in mots if w in of_things]
                words, names, work, wide = sorted({w for t in firms for w in firm(t)} - trades), own(acheteur, commune), work_kind(mots), [w for w in mots if len(w) >= 6 and w not in common]
                narrow.append(np.empty(0, np.int64) if ahead is None else keys_of(mots, rare.places(mots), names, words, month, work, ahead, True, True))
                every.append(keys_of(mots, wide, names, words, month, work, ahead or 0, ahead is not None, False))
                rows.append((names, usual.places(mots), thing, work, kind(acheteur), words, "".join(mots), squeeze(acheteur), "".join(squeeze(t) for t in firms)))
            read = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(read, types, strict=True)), _lists(narrow, None), _lists(every, bits)], names=[*batch.schema.names, *_READ_NAMES])

    return run


def frequent_words(contracts: DataFrame) -> tuple[list[str], list[str]]:
    """(words in more than a fixed share of all subjects, those of them that many buyers use: things, not quarters of one town).

    At most (words per subject) / RARE_SHARE of them, whatever the size.
    """
    by_buyer = contracts.select(F.coalesce("acheteur_id", F.lit("")).alias("qui"), F.explode(F.array_distinct("mots")).alias("mot")).groupBy("mot", "qui").agg(F.count(F.lit(1)).alias("n"))
    words = by_buyer.groupBy("mot").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("acheteurs"))
    whole = contracts.agg(F.count(F.lit(1)), F.count_distinct(F.coalesce("acheteur_id", F.lit("")))).first()
    found = words.filter(F.col("df") > max(RARE_LEAST, int(RARE_SHARE * whole[0]))).orderBy("mot").collect()
    return [r.mot for r in found], [r.mot for r in found if r.acheteurs >= BUYERS_SHARE * whole[1]]


def generic_words(contracts: DataFrame) -> list[str]:
    """Words of suppliers' names that say a trade, not a firm: seen beside at least a fixed share of all other words (so few, whatever the size)."""
    names = contracts.select(F.explode("titulaires").alias("nom")).distinct().select(F.array_distinct(F.filter(F.split("nom", " "), lambda w: F.length(w) >= 3)).alias("m"))
    words = names.select(F.explode("m").alias("mot"), "m")
    degree = words.select("mot", F.explode("m").alias("autre")).distinct().groupBy("mot").agg((F.count(F.lit(1)) - 1).alias("degre"))
    total = words.select("mot").distinct().count()
    return sorted(r.mot for r in degree.filter(F.col("degre") >= max(GENERIC_LEAST, int(GENERIC_SHARE * total))).collect())


def common_holders(records: DataFrame, words: str) -> list[str]:
    """Own words of the buyers or suppliers that hold at least HOLDER_SHARE of the contracts: at most a few hundred."""
    counted = records.select(F.explode(F.array_distinct(words)).alias("mot")).groupBy("mot").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r.mot for r in counted.filter(F.col("n") >= max(RARE_LEAST, int(HOLDER_SHARE * records.count()))).collect())


def keyed(contracts: DataFrame) -> DataFrame:
    """(contrat, cle, _n): every key of the contracts with the number of contracts that have it."""
    c = contracts.select(F.col("ident").alias("contrat"), F.explode("cles_toutes").alias("cle"))
    return materialise(c.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cle"))), "cles-contrats")


def candidates(notices: DataFrame, contracts: DataFrame, wide: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """(idweb, contrat, poids): the candidate graph after meta-blocking, over the narrow keys of the notices or over all.

    Blocks of a key that many contracts share are split by contract; every part meets all notices of the key.
    keys: those of the contracts, if they are there already.
    """
    n = notices.select(F.col("ident").alias("idweb"), F.explode("cles_toutes" if wide else "cles").alias("cle"))
    c, on = keyed(contracts) if keys is None else keys, ["cle"]
    large = c.filter(F.col("_n") > BLOCK_CONTRACTS).select("cle", F.ceil(F.col("_n") / F.lit(BLOCK_CONTRACTS)).cast("int").alias("_p")).distinct()
    if many := large.count():
        large = F.broadcast(large.limit(KEYS_BROADCAST + 1)) if many <= KEYS_BROADCAST else shuffled(large)
        n = n.join(large, "cle", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_p", F.lit(1)) - 1)))
        c = c.join(large, "cle", "left").withColumn("_part", F.pmod(F.xxhash64("contrat"), F.coalesce("_p", F.lit(1))).cast("int"))
        on = ["cle", "_part"]
    # All edges of a notice meet in one place: summed, weighed against their mean and joined to the notice without moving again.
    edges = n.join(shuffled(c), on).select("idweb", "contrat", (1.0 / F.col("_n")).alias("rarete")).repartition("idweb")
    edges = edges.groupBy("idweb", "contrat").agg(F.sum("rarete").alias("poids")).withColumn("moyenne", F.avg("poids").over(Window.partitionBy("idweb")))
    # An edge just at the bound stays, in whatever order the weights were summed.
    return edges.filter(F.col("poids") >= (PRUNE - 1e-9) * F.col("moyenne")).select("idweb", "contrat", "poids")


def _near(a: Column, b: Column) -> Column:
    """``near`` in the JVM."""
    size, d = F.least(F.length(a), F.length(b)), F.levenshtein(a, b, 2)
    letters = lambda w: F.array_sort(F.split(w, ""))
    return (a == b) | ((size >= 5) & (d >= 0) & ((d <= 1) | (size >= 10) | (letters(a) == letters(b))))


# How far the two ends of an edge agree on each attribute: level 0 where either does not state it.
# For each level, the share of it among true pairs to begin with.
LEVELS = {
    # Place (none stated, other, some of the places, all) with thing (not stated, no word of it, some, all): the
    # two go together, since other purchases for one place, and for one thing at other places, are many.
    "objet": tuple(a * b for a in (0.25, 0.003, 0.067, 0.68) for b in (0.02, 0.005, 0.085, 0.89)),
    "travail": (0.01, 0.99),
    "acheteur": (0.01, 0.42, 0.57),  # other, same and common, same and rare
    "genre": (0.04, 0.96),
    "delai": (0.01, 0.94, 0.04, 0.01),  # award before its notice, within about a year, later, much later
    "montant": (0.40, 0.25, 0.20, 0.15),  # by growing distance
    "fournisseur": (0.02, 0.43, 0.55),  # other, same and common, same and rare
    "famille": (0.10, 0.90),
}


def _agreement(edges: DataFrame, common_buyers: list[str], common_firms: list[str]) -> DataFrame:
    """Adds the level of each attribute of an edge, from the columns n_ of its notice and c_ of its contract."""
    n, c = (lambda k: F.col(f"n_{k}")), (lambda k: F.col(f"c_{k}"))
    lit = lambda ws: F.array(*[F.lit(w) for w in ws]).cast("array<string>")
    both = lambda k: (F.size(n(k)) > 0) & (F.size(c(k)) > 0)
    in_notice = lambda w, glued: F.contains(n(glued), w) | F.exists(n("mots"), lambda v: _near(w, v))
    # What compares words with words comes first and once; the levels read it.
    hits, said, agreed = F.col("_lieux"), F.col("_choses"), {"noms": F.col("_noms"), "firmes": F.col("_firmes")}
    edges = edges.withColumn("_lieux", F.size(F.filter(c("lieux"), lambda w: in_notice(w, "colle"))))
    back = F.exists(n("lieux"), lambda w: F.contains(c("colle"), w))
    place = F.when(F.size(c("lieux")) == 0, 0).when(hits == F.size(c("lieux")), 3).when((hits > 0) | back, 2).when(F.size(n("lieux")) > 0, 1).otherwise(0)
    edges = edges.withColumn("_choses", F.size(F.filter(c("choses"), lambda t: F.exists(n("mots"), lambda v: _near(t, v) | ((F.length(v) >= 4) & F.startswith(t, v))) | ((F.length(t) >= 6) & F.contains(n("colle"), t)))))
    thing = F.when((F.size(c("choses")) == 0) | (F.size(n("mots")) == 0), 0).when(said == F.size(c("choses")), 3).when(said > 0, 2).otherwise(1)
    same = lambda k: F.when((n(k) == "") | (c(k) == "") | n(k).isNull() | c(k).isNull(), 0).when(n(k) == c(k), 2).otherwise(1)

    shared = lambda words, glued: F.when(both(words), F.filter(c(words), lambda w: F.exists(n(words), lambda v: _near(w, v)) | F.contains(n(glued), w)))
    edges = edges.withColumns({"_noms": shared("noms", "acheteur_colle"), "_firmes": shared("firmes", "firme_colle")})

    def holder(words: str, common: list[str]) -> Column:
        return F.when(agreed[words].isNull(), 0).when(F.size(agreed[words]) == 0, 1).when(F.size(F.array_except(agreed[words], lit(common))) == 0, 2).otherwise(3)

    days = F.datediff(c("date"), n("date"))
    delay = F.when(days.isNull(), 0).when(days < 0, 1).when(days <= 400, 2).when(days <= 550, 3).otherwise(4)
    gap = F.array_min(F.transform(c("montants"), lambda v: F.abs(v - n("montant"))))
    amount = F.when(gap.isNull(), 0).when(gap < 0.1, 1).when(gap < 0.2, 2).when(gap < 0.4, 3).otherwise(4)
    levels = {"objet": 1 + 4 * place + thing, "travail": same("travail"), "acheteur": holder("noms", common_buyers), "genre": same("genre"), "delai": delay, "montant": amount, "fournisseur": holder("firmes", common_firms), "famille": same("famille")}
    return edges.withColumns(levels)


EDGE = "idweb string, contrat string, score double, acheteur_contrat string, acheteur_avis string, titulaire_avis string, titulaires_contrat array<string>, date date"
# Log-odds of no contract at all, beside the prior odds in the scores; half of what full support adds.
NULL_SCORE = 0.75
SUPPORT = 1.5
# exp(SUPPORT + NULL_SCORE) times the odds of this share stay far under even.
HOPELESS = 0.01
# Pseudo-counts behind the shares to begin with, and behind even shares among untrue pairs; how far one judged pair is believed; rounds of the fit.
BEGIN_WEIGHT, CHANCE_WEIGHT, BELIEF, FIT_ROUNDS = 10.0, 100.0, 0.97, 200


def learn_weights(patterns: pd.DataFrame) -> tuple[dict[str, list[float]], float]:
    """(log-odds by attribute and level, share of true pairs among edges), by expectation and maximisation.

    How true pairs agree is learned from those judged true, each weighed by how far the rest of its
    levels bears the verdict out; how others agree by chance, and how many edges are true, from all edges.

    patterns: one row per combination of levels, with ``n`` edges, of which ``oui`` and ``non`` were
    judged by hand.  At most (product of the numbers of levels) rows, whatever the number of edges.
    """
    names = list(LEVELS)
    levels, n = patterns[names].to_numpy(int), patterns["n"].to_numpy(float)
    yes, no = patterns["oui"].to_numpy(float), patterns["non"].to_numpy(float)
    free = n - yes - no
    m = [np.array(LEVELS[k], float) for k in names]
    counted = lambda w: [np.bincount(levels[:, k], w, len(LEVELS[a]) + 1)[1:] for k, a in enumerate(names)]
    u = [np.full(len(LEVELS[k]), 1 / len(LEVELS[k])) for k in names]
    share, weights = 0.1, None
    for _ in range(FIT_ROUNDS):
        before, weights = weights, [np.concatenate([[0.0], np.log(a / b)]) for a, b in zip(m, u, strict=True)]
        if before is not None and max(np.abs(a - b).max() for a, b in zip(weights, before, strict=True)) < 1e-4:
            break
        total = np.clip(np.log(share / (1 - share)) + sum(w[levels[:, k]] for k, w in enumerate(weights)), -500, 500)
        doubt = np.log(BELIEF / (1 - BELIEF))
        p, if_yes, if_no = (1 / (1 + np.exp(-(total + d))) for d in (0.0, doubt, -doubt))
        right = free * p + yes * if_yes + no * if_no
        share = float(np.clip(right.sum() / max(n.sum(), 1.0), 1e-6, 0.95))
        m = [(x + BEGIN_WEIGHT * np.array(LEVELS[a])) / (x.sum() + BEGIN_WEIGHT) for a, x in zip(names, counted(yes * if_yes), strict=True)]
        u = [(x + CHANCE_WEIGHT / len(x)) / (x.sum() + CHANCE_WEIGHT) for x in counted(n - right)]
    return {a: w.tolist() for a, w in zip(names, weights, strict=True)}, share


def scored(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds ``score``: the log-odds of each edge from its levels, with prior odds that fall with the number of its notice's candidates."""
    names = list(LEVELS)
    tally = edges.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        tally = tally.withColumn("oui", F.lit(0)).withColumn("non", F.lit(0))
    else:
        judged = edges.join(labels, ["idweb", "_objet"]).groupBy(*names).agg(F.count_if("juste").alias("oui"), F.count_if(~F.col("juste")).alias("non"))
        tally = tally.join(judged, names, "left").fillna(0, ["oui", "non"])
    patterns = tally.toPandas()
    if patterns.empty:
        return edges.withColumn("score", F.lit(0.0))
    weights, share = learn_weights(patterns)
    notices = edges.select("idweb").distinct().count()
    prior = min(max(share * patterns["n"].sum() / notices, 0.05), 0.95)
    evidence = sum((F.element_at(F.array(*[F.lit(float(v)) for v in w]), F.col(a) + 1) for a, w in weights.items()), F.lit(0.0))
    many = edges.groupBy("idweb").agg(F.count(F.lit(1)).alias("_voisins"))
    return edges.join(many, "idweb").withColumn("score", evidence + F.lit(float(np.log(prior / (1 - prior)))) - F.log("_voisins")).drop("_voisins")


def _shares(edges: DataFrame) -> DataFrame:
    """Adds ``part``: the edge's share among its notice's edges and the case that none is right."""
    own = Window.partitionBy("idweb")
    top = F.greatest(F.max("total").over(own), F.lit(NULL_SCORE))
    x = edges.withColumn("_top", top).withColumn("_e", F.exp(F.col("total") - F.col("_top")))
    return x.withColumn("part", F.col("_e") / (F.sum("_e").over(own) + F.exp(F.lit(NULL_SCORE) - F.col("_top")))).drop("_e", "_top")


def _support(edges: DataFrame) -> DataFrame:
    """(idweb, contrat, dit): how far the buyer or a supplier of the notice goes with that of the contract, over the shares of all other edges."""
    pairs = lambda left, right: F.when(F.col(left).isNotNull() & (F.col(left) != ""), F.transform(right, lambda r, i: F.struct(F.lit(left).alias("_nom"), F.col(left).alias("_g"), r.alias("_d"), (i == 0).alias("_un"))))
    none = F.array().cast("array<struct<_nom:string,_g:string,_d:string,_un:boolean>>")
    every = F.concat(F.coalesce(pairs("acheteur_avis", F.array_compact(F.array("acheteur_contrat"))), none), F.coalesce(pairs("titulaire_avis", F.col("titulaires_contrat")), none))
    known = edges.select("idweb", "contrat", "part", F.inline(every))
    pair = known.groupBy("_nom", "_g", "_d").agg(F.sum("part").alias("_ensemble"))
    # An edge counts once for its notice's label, however many suppliers its contract has.
    alone = known.filter("_un").groupBy("_nom", "_g").agg(F.sum("part").alias("_seul"))
    # An edge's own share is no evidence for itself.
    says = (F.col("_ensemble") - F.col("part")) / (F.col("_seul") - F.col("part") + 1.0)
    return known.join(pair, ["_nom", "_g", "_d"]).join(alone, ["_nom", "_g"]).groupBy("idweb", "contrat").agg(F.max(says).alias("dit"))


def hopeful(edges: DataFrame) -> DataFrame:
    """Edges that propagation may still make a link, and the best of each notice.

    Support multiplies the odds of an edge by at most exp(SUPPORT), and those of no contract not at all,
    so an edge with a share under HOPELESS can't come to ACCEPT.
    """
    best = Window.partitionBy("idweb").orderBy(F.col("part").desc(), "contrat")
    x = _shares(edges.withColumn("total", F.col("score"))).withColumn("_k", F.row_number().over(best))
    return x.filter((F.col("part") >= HOPELESS) | (F.col("_k") == 1)).drop("_k", "part", "total")


def propagate(edges: DataFrame) -> DataFrame:
    """Edges with their final ``part``: rounds until no share moves, with smaller steps where the moves do not shrink."""
    now = materialise(_shares(edges.withColumn("appui", F.lit(0.0)).withColumn("total", F.col("score"))), "parts")
    step, before = 1.0, None
    for _ in range(ROUNDS):
        x = now.withColumnRenamed("part", "_avant").join(_support(now), ["idweb", "contrat"], "left")
        x = x.withColumn("appui", F.col("appui") + step * (F.greatest(F.coalesce("dit", F.lit(0.0)), F.lit(0.0)) - F.col("appui"))).withColumn("total", F.col("score") + SUPPORT * F.col("appui")).drop("dit")
        following = materialise(_shares(x).withColumn("_ecart", F.abs(F.col("part") - F.col("_avant"))), "parts")
        moved = following.agg(F.max("_ecart")).first()[0]
        now = following.drop("_avant", "_ecart")
        # A move is measured as that of a whole step.
        if moved is None or moved / step < STILL:
            return now.drop("appui")
        if before is not None and moved / step >= before:
            before, step = moved / step, max(LEAST_STEP, step / 2)
        else:
            before = moved / step
    raise RuntimeError(f"shares still move by {before:.3g} after {ROUNDS} rounds")


def one_to_one(edges: DataFrame) -> DataFrame:
    """Shares once each contract goes to the notice that has the largest share of it: the others lose that edge.

    Repeated until no contract is the best of two notices; each round takes at least one edge away, and
    notices that lost none keep their shares.
    """
    now = edges
    while True:
        best = now.groupBy("idweb").agg(F.max_by(F.struct("contrat", "part"), F.struct("part", "contrat")).alias("b")).select("idweb", "b.*").filter(F.col("part") >= ACCEPT)
        claims = best.groupBy("contrat").agg(F.max_by("idweb", F.struct("part", "idweb")).alias("_garde"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        lost = materialise(best.join(claims, "contrat").filter("idweb <> _garde").select("idweb", "contrat"), "perdues")
        if lost.isEmpty():
            return now
        now = materialise(_shares(now.join(lost, ["idweb", "contrat"], "left_anti").drop("part")), "parts")


def _labels(verdicts: DataFrame) -> DataFrame:
    """(idweb, _objet, juste) of at most LABELS pairs judged by hand; a pair judged both ways or in doubt is none."""
    x = verdicts.filter(F.col("verdict_humain").isin("oui", "non") & F.col("idweb").isNotNull() & F.col("objet_decp").isNotNull()).select("idweb", fold(F.col("objet_decp")).alias("_objet"), (F.col("verdict_humain") == "oui").alias("juste"))
    return x.groupBy("idweb", "_objet").agg(F.bool_or("juste").alias("juste"), F.bool_and("juste").alias("_tous")).filter("juste = _tous").drop("_tous").limit(LABELS)


def _calibration(edges: DataFrame, judged: DataFrame) -> tuple[float, float]:
    """Slope and offset of the confidence, fitted on the labelled edges (at most LABELS labels); (1, 0) with too few."""
    x = edges.select("idweb", "contrat", "part").join(judged, ["idweb", "contrat"]).select("part", "juste").toPandas()
    if len(x) < 30 or x["juste"].nunique() < 2:
        return 1.0, 0.0
    p = np.clip(x["part"].to_numpy(float), 1e-6, 1 - 1e-6)
    z, y, w = np.log(p / (1 - p)), x["juste"].to_numpy(bool), np.array([1.0, 0.0])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -500, 500)))
        # A verdict may be wrong: how far each is believed depends on what the share says.
        right, wrong = np.where(y, BELIEF, 1 - BELIEF) * q, np.where(y, 1 - BELIEF, BELIEF) * (1 - q)
        t = right / (right + wrong)
        g = np.array([((t - q) * z).sum() - RIDGE * (w[0] - 1), (t - q).sum() - RIDGE * w[1]])
        s = q * (1 - q)
        h = np.array([[(s * z * z).sum() + RIDGE, (s * z).sum()], [(s * z).sum(), s.sum() + RIDGE]])
        w = w + np.clip(np.linalg.solve(h, g), -0.5, 0.5)
    return float(np.clip(w[0], 0.2, 2.0)), float(np.clip(w[1], -3.0, 3.0))


def link(avis: DataFrame, marches: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(idweb, marche_id, part, confiance): the best contract of each notice that has candidates."""
    split = lambda df: df.withColumn("_objet", fold(F.col("objet"))).drop("objet").withColumn("mots", F.filter(F.split(F.coalesce("_objet", F.lit("")), " "), lambda w: w != ""))
    contracts = materialise(split(_contracts(marches)), "contrats")
    notices = materialise(split(_notices(avis)), "avis")
    (frequent, things), generic = frequent_words(contracts), generic_words(contracts)
    sc = avis.sparkSession.sparkContext

    def read(df: DataFrame, ident: str, firms: Column, ahead: int | None, wanted: Broadcast | None, *also: str) -> DataFrame:
        x = df.withColumnRenamed(ident, "ident").withColumn("titulaires", firms).withColumn("mois", F.year("date") * 12 + F.month("date"))
        # Numbers stand for identifiers until edges are judged.
        x = x.select("ident", F.monotonically_increasing_id().alias("num"), "mots", "acheteur", "commune", "titulaires", "mois", "_objet", "date", "famille", *also)
        # The columns of a batch pass through as they are.
        return materialise(x.mapInArrow(_read_records(frequent, things, generic, ahead, wanted), f"{', '.join(f'{c} {t}' for c, t in x.dtypes)}, {READ}").drop("acheteur", "commune", "mois"), "lus")

    def spread(df: DataFrame) -> DataFrame:
        """``df`` in three tasks a core at least: a record is few bytes and much work."""
        least = 3 * sc.defaultParallelism
        return df if df.rdd.getNumPartitions() >= least else df.repartition(least)

    notices = read(spread(notices), "idweb", F.array_compact(F.array("titulaire")), MONTHS, None, "montant")
    # The narrow keys are among all keys.
    wanted = sc.broadcast(bitmap_of(notices.select(F.explode("cles_toutes").alias("trace"))))
    contracts = read(spread(contracts), "contrat", F.col("titulaires"), None, wanted, "montants", "acheteur_id")
    common = common_holders(contracts, "noms"), common_holders(contracts, "firmes")
    stated = ["mots", "date", "famille", *[c for c in _READ_NAMES if not c.startswith("cles")]]
    n = notices.select(F.col("num").alias("_avis"), F.col("ident").alias("idweb"), F.col("montant").alias("n_montant"), *[F.col(x).alias(f"n_{x}") for x in stated])
    c = contracts.select(F.col("num").alias("_marche"), F.col("ident").alias("contrat"), F.col("montants").alias("c_montants"), "acheteur_id", "titulaires", "_objet", *[F.col(x).alias(f"c_{x}") for x in stated])
    numbered = lambda df: df.withColumn("ident", F.col("num"))
    keys = keyed(numbered(contracts))

    def judged(graph: DataFrame) -> DataFrame:
        x = graph.select(F.col("idweb").alias("_avis"), F.col("contrat").alias("_marche")).join(shuffled(n), "_avis").join(shuffled(c), "_marche")
        buyer, firm = F.nullif(F.array_join(F.array_sort("n_noms"), ""), F.lit("")), F.nullif(F.col("n_firme_colle"), F.lit(""))
        return materialise(_agreement(x, *common).select("_avis", "_marche", "idweb", "contrat", "_objet", *LEVELS, F.col("acheteur_id").alias("acheteur_contrat"), buyer.alias("acheteur_avis"), firm.alias("titulaire_avis"), F.col("titulaires").alias("titulaires_contrat"), F.col("c_date").alias("date")), "jugees")

    labels = None if verdicts is None else materialise(_labels(verdicts), "verdicts")
    edges = judged(candidates(numbered(notices), contracts, keys=keys))
    first = _shares(scored(edges, labels).withColumn("total", F.col("score")))
    # A second round, with every key, for notices without an accepted edge.
    rest = numbered(notices).select("ident", "cles_toutes").join(first.filter(F.col("part") >= ACCEPT).select(F.col("_avis").alias("ident")).distinct(), "ident", "left_anti")
    known = edges.select(F.col("_avis").alias("idweb"), F.col("_marche").alias("contrat"))
    every = edges.unionByName(judged(candidates(materialise(rest, "avis-sans-contrat"), contracts, True, keys).join(known, ["idweb", "contrat"], "left_anti")))
    final = one_to_one(propagate(hopeful(scored(every, labels).drop("_objet", "_avis", "_marche", *LEVELS))))
    order = F.struct(F.col("part"), -F.unix_date(F.coalesce("date", F.lit("2100-01-01").cast("date"))), F.col("contrat"))
    best = final.groupBy("idweb").agg(F.max_by(F.struct("contrat", "part", "total"), order).alias("b")).select("idweb", "b.*")
    a, b = (1.0, 0.0) if labels is None else _calibration(final, every.join(labels, ["idweb", "_objet"]).select("idweb", "contrat", "juste"))
    p = F.least(F.greatest(F.col("part"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return best.select("idweb", F.col("contrat").alias("marche_id"), "part", (1 / (1 + F.exp(-(a * F.log(p / (1 - p)) + b)))).alias("confiance"))
