"""Best representative of each duplicate group: currency reasoning.

1. Precedence is learned from rows that state their version: of every ordered field, how often its
   value grows, falls or stays from one stated version to the next; of every field with few values,
   which value follows which.  A field whose moves go one way in nearly every transition (a duration
   that only grows, say), or a pair of values that nearly always come in one order, tells which of
   two rows is the later one.
2. Every group gets a partial order.  Its nodes are the distinct states of its rows: the level -- the
   stated version, or, where none is stated, the place between the stated versions that the learned
   fields give, the most reliable field first, then an amount that one version shares, then the
   learned pairs of values, then the publication date -- and the value of the most reliable field,
   which may be null.  One node precedes another if its level is lower, or at equal level if both have
   that value and its own comes earlier.
3. The topologically latest nodes, those that precede no other, state the current version.  Among
   their rows the one that lost least survives: fewest nulls, subject neither cut nor a placeholder,
   amount not rounded.  A row that lost its amount, its duration or its subject where another row of
   the group has them is a careless copy: it is no evidence of a version and never survives while the
   group has a whole row.

Everything is an aggregate with map-side combine: a group of copies, however many, is never
collected; per group only one entry for each stated version and each distinct state is held.

Defined results: rows that differ in nothing but ``id`` give the smallest id; a group of one row
gives no row; rows without a contract number take part in no group; a null supplier name with a null
identifier is one unknown supplier of its contract; empty tables give no row; extra columns are
carried by nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ardoise.functions.text import contract_number, fold
from ardoise.session import BROADCAST_ROWS, materialise

# A field is a currency field if at least this share of at least so many transitions go one way.
CURRENCY_SHARE = 0.95
CURRENCY_LEAST = 20
ORDERED = ("duree_mois", "offres_recues", "montant", "distance_km", "date_notification")
VALUED = ("nature", "procedure", "acheteur_categorie", "titulaire_categorie")
# A field takes part in the learning of pairs if it has at most so many values.
VALUES_MOST = 50
# Texts that stand for a subject that was not given, folded.
PLACEHOLDERS = ("", "nc", "a renseigner", "sans objet", "non renseigne", "neant", "xxx", "test", "n a")
CONTENT = (
    "acheteur_siret", "acheteur_nom", "acheteur_categorie", "acheteur_departement_code", "acheteur_departement_nom", "acheteur_region_nom", "acheteur_commune_nom",
    "titulaire_siret", "titulaire_nom", "titulaire_categorie", "distance_km", "objet", "nature", "famille_cpv", "code_cpv", "procedure", "montant", "duree_mois", "offres_recues", "date_notification",
)


def _two_digits(x: Column) -> Column:
    """x rounded to two significant digits."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 1)
    return F.when(x == 0, x).otherwise(F.round(x / unit) * unit)


def awards(marches: DataFrame) -> DataFrame:
    """Rows with their award: ``contrat`` and ``fournisseur``, and what their loss is.

    A supplier is its nine-digit firm number; a row without one takes it from a row of its contract
    under the same name, else the name itself stands for the supplier.
    """
    name = F.coalesce(F.nullif(fold(F.col("titulaire_nom")), F.lit("")), F.lit("?"))
    siren = F.when(F.col("titulaire_siret").rlike(r"^\d{14}$"), F.substring("titulaire_siret", 1, 9))
    subject = fold(F.col("objet"))
    cut = F.col("objet").rlike(r"(\.\.\.|…)\s*$") | subject.isin(*PLACEHOLDERS)
    nulls = sum((F.col(c).isNull().cast("int") for c in CONTENT), F.lit(0))
    rounded = F.abs(_two_digits(F.col("montant")) - F.col("montant")) < 1e-6 * F.abs("montant")
    loss = 2 * nulls + F.when(cut, 6).otherwise(0) + F.when(rounded, 1).otherwise(0)
    whole = F.col("montant").isNotNull().cast("int") + F.col("duree_mois").isNotNull().cast("int") + F.coalesce(~cut, F.lit(False)).cast("int")
    number = lambda c: F.unix_date(c).cast("double") if c.startswith("date") else F.col(c).cast("double")
    learned = [number(c).alias(f"_{c}") for c in ORDERED] + [F.col(c).alias(f"_{c}") for c in VALUED]
    rows = marches.select("id", contract_number(F.col("marche_id"), F.col("uid")).alias("contrat"), name.alias("_nom"), siren.alias("_siren"), F.col("modification_id").cast("int").alias("version"), F.col("date_publication").alias("date"), loss.alias("perte"), whole.alias("entier"), F.coalesce(F.length("objet"), F.lit(0)).alias("longueur"), *learned).filter(F.col("contrat").isNotNull())
    # Written once: what is read off contract numbers costs more than the scans that follow.
    rows = materialise(rows, "lignes")
    missing = rows.filter(F.col("_siren").isNull()).select("contrat", "_nom").distinct()
    known = materialise(rows.filter(F.col("_siren").isNotNull()).join(missing, ["contrat", "_nom"], "left_semi").groupBy("contrat", "_nom").agg(F.max("_siren").alias("_connu")), "connus")
    few = known.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(known) if few else known, ["contrat", "_nom"], "left")
    rows = rows.withColumn("fournisseur", F.coalesce("_siren", "_connu", "_nom")).drop("_nom", "_siren", "_connu")
    return rows if few else materialise(rows, "attributions")


def _versions(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row per stated version of an award, with the values of its fullest row."""
    best = F.max_by(F.struct(*fields), F.struct(-F.col("perte"), -F.col("id")))
    return rows.filter(F.col("version").isNotNull()).groupBy("contrat", "fournisseur", "version").agg(best.alias("_v"), F.min("date").alias("date")).select("contrat", "fournisseur", "version", "date", "_v.*")


def learn_precedence(known: DataFrame) -> tuple[list[tuple[str, int, float]], dict[str, list[tuple[str, str]]]]:
    """What orders versions: (field, 1 if it grows or -1, share of transitions), the most reliable first; and by field the pairs (earlier, later) of values.

    known: one row per stated version of an award.
    """
    w = Window.partitionBy("contrat", "fournisseur").orderBy("version")
    moves = known.select(*[F.signum(F.col(f"_{c}") - F.lag(f"_{c}").over(w)).alias(f"_{c}") for c in ORDERED])
    counts = moves.agg(*[x for c in ORDERED for x in (F.count_if(F.col(f"_{c}") > 0).alias(f"u_{c}"), F.count_if(F.col(f"_{c}") < 0).alias(f"d_{c}"), F.count(f"_{c}").alias(f"n_{c}"))]).first()
    fields = []
    for c in ORDERED:
        n = counts[f"n_{c}"]
        for way, k in ((1, counts[f"u_{c}"]), (-1, counts[f"d_{c}"])):
            if n >= CURRENCY_LEAST and k / n >= CURRENCY_SHARE:
                fields.append((c, way, k / n))
    few = known.agg(*[F.approx_count_distinct(f"_{c}").alias(c) for c in VALUED]).first()
    valued = [c for c in VALUED if few[c] <= VALUES_MOST]
    pairs: dict[str, list[tuple[str, str]]] = {}
    if valued:
        steps = known.withColumns({f"_a{c}": F.lag(f"_{c}").over(w) for c in valued}).select(F.explode(F.array(*[F.struct(F.lit(c).alias("champ"), F.col(f"_a{c}").alias("avant"), F.col(f"_{c}").alias("apres")) for c in valued])).alias("p")).select("p.*").filter("avant <> apres")
        # At most VALUES_MOST squared rows a field.
        seen = {(r.champ, r.avant, r.apres): r.n for r in steps.groupBy("champ", "avant", "apres").agg(F.count(F.lit(1)).alias("n")).collect()}
        for (c, x, y), n in sorted(seen.items()):
            if n >= CURRENCY_LEAST and n / (n + seen.get((c, y, x), 0)) >= CURRENCY_SHARE:
                pairs.setdefault(c, []).append((x, y))
    return sorted(fields, key=lambda f: -f[2]), pairs


def ordered(marches: DataFrame) -> DataFrame:
    """The rows of all awards with their node (``entier``, ``niveau``, ``monnaie``) and ``rang``: a struct that grows along a linear extension of the group's order."""
    rows = awards(marches)
    known = materialise(_versions(rows, [f"_{c}" for c in (*ORDERED, *VALUED)]), "versions")
    fields, pairs = learn_precedence(known)
    key = ["contrat", "fournisseur"]
    rows = rows.withColumn("_monnaie", F.col(f"_{fields[0][0]}") * fields[0][1] if fields else F.lit(None).cast("double"))
    unstated = rows.filter(F.col("version").isNull())
    used = sorted({"_montant", *[f"_{c}" for c, _, _ in fields], *[f"_{c}" for c in pairs]})
    stated = known.select(*key, "version", "date", *used).join(unstated.select(*key).distinct(), key, "left_semi")
    versions = stated.groupBy(*key).agg(F.collect_list(F.struct("version", "date", *used)).alias("_versions"))
    x = unstated.join(versions, key, "left")

    def latest(keep) -> Column:
        return F.array_max(F.transform(F.filter(F.col("_versions"), keep), lambda v: v["version"])).cast("double")

    def by_field(f: str, way: int) -> Column:
        same = latest(lambda v: v[f] == F.col(f))
        after = F.coalesce(latest(lambda v: v[f] * way < F.col(f) * way), F.lit(-1.0)) + 0.5
        return F.when(F.col(f).isNotNull() & F.exists("_versions", lambda v: v[f].isNotNull()), F.coalesce(same, after))

    def by_pairs(f: str, known: list[tuple[str, str]]) -> Column:
        both = F.array(*[F.struct(F.lit(a), F.lit(b)) for a, b in known])
        return latest(lambda v: F.array_contains(both, F.struct(v[f], F.col(f)))) + 0.5

    levels = [by_field(f"_{c}", way) for c, way, _ in fields]
    levels.append(latest(lambda v: (v["_montant"] == F.col("_montant")) | (F.abs(_two_digits(v["_montant"]) - F.col("_montant")) < 1e-6 * F.abs(F.col("_montant")))))
    levels += [by_pairs(f"_{c}", known) for c, known in pairs.items()]
    levels.append(F.coalesce(latest(lambda v: v["date"] <= F.col("date")), F.lit(-1.0)) + 0.5)
    x = x.withColumn("niveau", F.coalesce(*levels)).drop("_versions")
    both = rows.filter(F.col("version").isNotNull()).withColumn("niveau", F.col("version").cast("double")).unionByName(x)
    date_key = F.when(F.col("_monnaie").isNull() & F.col("version").isNull(), F.col("date").cast("timestamp"))
    loss = F.struct((-F.col("perte")).alias("complet"), "longueur", date_key.alias("date"), (-F.col("id")).alias("id"))
    return both.withColumn("monnaie", F.col("_monnaie")).withColumn("etat", loss).withColumn("rang", F.struct("entier", "niveau", F.coalesce("_monnaie", F.lit(float("-inf"))).alias("monnaie"), "etat"))


def survivors(marches: DataFrame) -> DataFrame:
    """(id_groupe, id, lignes) of every award with two or more rows."""
    key = ["contrat", "fournisseur"]
    nodes = ordered(marches).groupBy(*key, "entier", "niveau", "monnaie").agg(F.max("etat").alias("etat"), F.min("id").alias("premier"), F.count(F.lit(1)).alias("lignes"))
    # The frontier of each group: its highest level, and the latest value there.
    high = nodes.groupBy(*key, "entier", "niveau").agg(F.max("monnaie").alias("monnaie"), F.max(F.when(F.col("monnaie").isNull(), F.col("etat"))).alias("_sans"), F.max_by("etat", "monnaie").alias("_avec"), F.min("premier").alias("premier"), F.sum("lignes").alias("lignes"))
    # A node that precedes no other has that value or none.
    high = high.withColumn("etat", F.greatest("_sans", F.when(F.col("monnaie").isNotNull(), F.col("_avec"))))
    x = high.groupBy(*key).agg(F.max_by("etat", F.struct("entier", "niveau")).alias("etat"), F.min("premier").alias("id_groupe"), F.sum("lignes").alias("lignes"))
    return x.filter("lignes >= 2").select("id_groupe", (-F.col("etat.id")).alias("id"), "lignes")


def fused(marches: DataFrame, fields: list[str]) -> DataFrame:
    """One built record per award with two or more rows: of each field the latest value that is not null."""
    ranks = ordered(marches).select("id", "contrat", "fournisseur", "rang")
    x = ranks.join(marches.select("id", *[F.col(f).alias(f"_f_{f}") for f in fields]), "id")
    built = x.groupBy("contrat", "fournisseur").agg(F.min("id").alias("id_groupe"), F.count(F.lit(1)).alias("lignes"), *[F.max_by(f"_f_{f}", F.when(F.col(f"_f_{f}").isNotNull(), F.col("rang"))).alias(f) for f in fields])
    return built.filter("lignes >= 2").drop("fournisseur")
