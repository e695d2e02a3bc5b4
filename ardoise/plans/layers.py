"""Queries of the layers: quality flags, normalisation, gold, features, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.functions.columns import half_up
from ardoise.functions.text import normalised_label
from ardoise.operators import layers as L
from ardoise.plans import oracle as O
from ardoise.session import table


def _marches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "marches")


def _silver(spark: SparkSession, d: str) -> DataFrame:
    return L.silver(_marches(spark, d))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return L.gold(_silver(spark, d))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return L.signals(L.features(_gold(spark, d)))


def src_parquet_unifie(spark: SparkSession, d: str) -> DataFrame:
    """SRC-1: several files read as one table, columns unified by name."""
    x = L.bronze(spark, f"{d}/{{marches,avis}}.parquet")
    return x.agg(F.count("id").alias("marches"), F.count("idweb").alias("avis"), F.count(F.lit(1)).alias("lignes"))


def perimetre_courant(spark: SparkSession, d: str) -> DataFrame:
    """SRC-3, FIL-1."""
    return L.current(_marches(spark, d)).select("id", "marche_id", "donneesActuelles")


def argent_drapeaux(spark: SparkSession, d: str) -> DataFrame:
    """FIL-3, PRJ-2, ARR-1: every rule as a flag, the reasons in order."""
    return _silver(spark, d).select("id", *L.rules(), "motifs_rejet", "exploitable_pour_les_prix")


def argent_violations(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17: violations of every rule, in one pass."""
    return _silver(spark, d).agg(F.count(F.lit(1)).alias("lignes"), F.count_if("exploitable_pour_les_prix").alias("exploitables"), *[F.count_if(~F.col(n)).alias(n) for n in L.rules()])


def normalisation_effet(spark: SparkSession, d: str) -> DataFrame:
    """AGG-19, AGG-38, PRJ-3: rows and spellings of each normalised label."""
    return _marches(spark, d).groupBy(normalised_label(F.col("nature")).alias("libelle")).agg(F.count(F.lit(1)).alias("lignes"), F.count_distinct("nature").alias("graphies"))


def or_marches(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-1, PRJ-4..7, FIL-2: the gold projection."""
    return _gold(spark, d)


def or_variables(spark: SparkSession, d: str) -> DataFrame:
    """AGG-1..3, JOI-1, MTH-3, PRJ-13, PRJ-14: features of every gold row."""
    x = L.features(_gold(spark, d))
    return x.select("id", "marches_famille", half_up(F.col("mediane"), 4).alias("mediane"), half_up(F.col("q1"), 4).alias("q1"), half_up(F.col("q3"), 4).alias("q3"), "marches_acheteur", "titulaires_acheteur", half_up(F.col("mediane_acheteur"), 2).alias("mediane_acheteur"), "marches_ensemble", half_up(F.col("montant_ensemble"), 2).alias("montant_ensemble"), "ecart", "part_titulaire", "diversite", "montant_par_mois", "fin_annee", "avant_vacances", "proche")


def or_signaux(spark: SparkSession, d: str) -> DataFrame:
    """SIG-1..10, AGT-1: flags, their number and the reasons."""
    return _signals(spark, d).select("id", "famille", "ecart", "tres_eleve", "a_verifier", "tres_bas", "offre_unique_gros", "dominant", "signaux_forts", "motifs")


def signaux_comptes(spark: SparkSession, d: str) -> DataFrame:
    """AGG-9, AGG-21."""
    x = _signals(spark, d)
    return x.agg(F.count(F.lit(1)).alias("lignes"), *[F.count_if(n).alias(n) for n in ("tres_eleve", "a_verifier", "tres_bas", "offre_unique_gros", "dominant")], F.count_if(F.col("signaux_forts") > 0).alias("signales"))


def couches_tailles(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18, SRC-15: rows and columns of each layer."""
    b, s, g = _marches(spark, d), _silver(spark, d), _gold(spark, d)
    out = [x.agg(F.count(F.lit(1)).alias("lignes")).select(F.lit(n).alias("couche"), "lignes", F.lit(len(x.columns)).alias("colonnes")) for n, x in (("bronze", b), ("argent", s), ("or", g))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def contrats_de_donnees(spark: SparkSession, d: str) -> DataFrame:
    """CTR-1..4: data contracts as rows (rule, severity, violations)."""
    from ardoise.operators.contracts import Rule, check

    g, s = _gold(spark, d), _silver(spark, d)
    natures = ["MARCHE", "ACCORD CADRE", "MARCHE SUBSEQUENT", "MARCHE DE PARTENARIAT", "DELEGATION DE SERVICE PUBLIC", "CONCESSION DE SERVICES"]
    silver_rules = [
        Rule("argent.id.not_null", "error", F.col("id").isNotNull()),
        Rule("argent.marche_id.not_null", "warn", F.col("marche_id").isNotNull()),
        Rule("argent.nature.accepted_values", "warn", F.col("nature_normalisee").isNull() | F.col("nature_normalisee").isin(natures)),
    ]
    gold_rules = [
        Rule("or.famille.expression", "warn", F.col("famille").isNull() | F.col("famille").rlike("^[0-9]{2}$")),
        Rule("or.acheteur_id.expression", "error", F.col("acheteur_id").rlike("^[0-9]{14}$")),
        Rule("or.montant.expression", "error", (F.col("montant") > 0) & (F.col("montant") <= 1e9)),
        Rule("or.annee.expression", "error", F.col("annee") >= 2015),
    ]
    return check(s, silver_rules).unionByName(check(g, gold_rules))


QUERIES = {f.__name__: f for f in (src_parquet_unifie, perimetre_courant, argent_drapeaux, argent_violations, normalisation_effet, or_marches, or_variables, or_signaux, signaux_comptes, couches_tailles, contrats_de_donnees)}
_NAT = "('MARCHE', 'ACCORD CADRE', 'MARCHE SUBSEQUENT', 'MARCHE DE PARTENARIAT', 'DELEGATION DE SERVICE PUBLIC', 'CONCESSION DE SERVICES')"


def _contract(name: str, severity: str, t: str, ok: str) -> str:
    return f"select '{name}' as regle, '{severity}' as severite, count(*) filter (where not coalesce({ok}, false)) as violations from {t}"


ORACLES = {
    "src_parquet_unifie": "select (select count(*) from marches) as marches, (select count(*) from avis) as avis, (select count(*) from marches) + (select count(*) from avis) as lignes",
    "perimetre_courant": "select id, marche_id, donneesActuelles from marches where donneesActuelles",
    "argent_drapeaux": O.sql(O.ARGENT, f"select id, {', '.join(O.FLAGS)}, motifs_rejet, exploitable_pour_les_prix from argent"),
    "argent_violations": O.sql(O.ARGENT, "select count(*) as lignes, count(*) filter (where exploitable_pour_les_prix) as exploitables, " + ", ".join(f"count(*) filter (where not {n}) as {n}" for n in O.FLAGS) + " from argent"),
    "normalisation_effet": f"select {O.NORM.format('nature')} as libelle, count(*) as lignes, count(distinct nature) as graphies from marches group by 1",
    "or_marches": O.sql(O.GOLD, "select * from gold"),
    "or_variables": O.sql(O.FEATURES, f"select id, marches_famille, {O.half('mediane', 4)} as mediane, {O.half('q1', 4)} as q1, {O.half('q3', 4)} as q3, marches_acheteur, titulaires_acheteur, {O.half('mediane_acheteur', 2)} as mediane_acheteur, marches_ensemble, {O.half('montant_ensemble', 2)} as montant_ensemble, ecart, part_titulaire, diversite, montant_par_mois, fin_annee, avant_vacances, proche from traits"),
    "or_signaux": O.sql(O.SIGNALS, "select id, famille, ecart, tres_eleve, a_verifier, tres_bas, offre_unique_gros, dominant, signaux_forts, motifs from sig"),
    "signaux_comptes": O.sql(O.SIGNALS, "select count(*) as lignes, " + ", ".join(f"count(*) filter (where {n}) as {n}" for n in ("tres_eleve", "a_verifier", "tres_bas", "offre_unique_gros", "dominant")) + ", count(*) filter (where signaux_forts > 0) as signales from sig"),
    "couches_tailles": O.sql(O.GOLD, "select 'bronze' as couche, count(*) as lignes, 32 as colonnes from marches union all select 'argent', count(*), 45 from argent union all select 'or', count(*), 25 from gold"),
    "contrats_de_donnees": O.sql(O.GOLD, " union all ".join([
        _contract("argent.id.not_null", "error", "argent", "id is not null"), _contract("argent.marche_id.not_null", "warn", "argent", "marche_id is not null"), _contract("argent.nature.accepted_values", "warn", "argent", f"nature_normalisee is null or nature_normalisee in {_NAT}"),
        _contract("or.famille.expression", "warn", "gold", "famille is null or regexp_matches(famille, '^[0-9]{2}$')"), _contract("or.acheteur_id.expression", "error", "gold", "regexp_matches(acheteur_id, '^[0-9]{14}$')"), _contract("or.montant.expression", "error", "gold", "montant > 0 and montant <= 1e9"), _contract("or.annee.expression", "error", "gold", "annee >= 2015"),
    ])),
}
ORACLES = O.typed(ORACLES)
