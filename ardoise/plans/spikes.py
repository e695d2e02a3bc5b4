"""Queries of problem 2: implausible readings in the amounts and in the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.functions.text import contract_number
from ardoise.operators.spikes import _join, flag_readings
from ardoise.session import small, table

# Hard bounds: an amount is positive and below this; a score is within this many deviations.
AMOUNT_BOUND = 1e13
SCORE_BOUND = 60.0
# A score follows from an amount if the score computed from the amount differs by at most this.
SCORE_TOLERANCE = 0.05
# The same where the row's own family figures are missing and those of the family stand in.
LOOSE_TOLERANCE = 1.0


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "marches").filter(F.col("montant").isNotNull())
    return m.select(
        F.lit("montant").alias("champ"), "id", "source", F.col("lot").cast("long").alias("lot"), F.col("montant").alias("valeur"), F.col("famille_cpv").alias("groupe"),
        F.xxhash64(contract_number(F.col("marche_id"), F.col("uid")), F.coalesce(F.upper("titulaire_nom"), F.col("titulaire_siret"))).alias("attribution"),
        F.when((F.col("montant") > 0) & (F.col("montant") < AMOUNT_BOUND), F.log10("montant")).alias("niveau"),
        ((F.col("montant") <= 0) | (F.col("montant") >= AMOUNT_BOUND) | F.isnan("montant")).alias("hors"),
        F.col("montant_anomalie").isNotNull().alias("indice"),
    )


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "signaux").filter(F.col("ecart_normalise_famille").isNotNull())
    v = F.col("ecart_normalise_famille")
    return s.select(
        F.lit("ecart_normalise_famille").alias("champ"), "id", "source", F.col("lot").cast("long").alias("lot"), v.alias("valeur"), F.col("famille_cpv").alias("groupe"),
        F.xxhash64(F.coalesce(F.col("marche_id"), F.col("id").cast("string"))).alias("attribution"),
        F.when(F.abs(v) < SCORE_BOUND, v).alias("niveau"), ((F.abs(v) >= SCORE_BOUND) | F.isnan(v)).alias("hors"), F.lit(False).alias("indice"),
    )


def _is_round() -> Column:
    """An ordinary round amount: at most three significant digits, and at least 1000."""
    v = F.abs(F.col("valeur"))
    unit = F.pow(F.lit(10.0), F.floor(F.log10(v)) - 2)
    return (F.col("champ") == "montant") & (v >= 1) & (F.abs(v / unit - F.round(v / unit)) < 1e-9)


def p2_etats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flagged reading with its state and the state's probability; scores that only follow from a wrong amount are marked."""
    flagged = small(flag_readings(_amounts(spark, sf_dir).unionByName(_scores(spark, sf_dir)), _is_round()), "etats")

    # What a wrong amount makes of the score of its contract's rows.
    m = table(spark, sf_dir, "marches").select("id", contract_number(F.col("marche_id"), F.col("uid")).alias("contrat"), "source", "montant")
    wrong = flagged.filter(F.col("champ") == "montant").select("id").join(m, "id").filter("montant > 0").select("contrat", F.col("source").alias("s_source"), F.log10("montant").alias("niveau_faux")).distinct()
    wrong = small(wrong, "niveaux-faux")
    s = table(spark, sf_dir, "signaux")
    usual = s.filter("mediane_log_famille is not null and ecart_log_famille > 0").groupBy("famille_cpv").agg(F.percentile_approx("mediane_log_famille", 0.5, 1000).alias("med_usuelle"), F.percentile_approx("ecart_log_famille", 0.5, 1000).alias("ecart_usuel"))
    usual = small(usual, "familles")
    rows = flagged.filter(F.col("champ") == "ecart_normalise_famille").join(s.select("id", contract_number(F.col("marche_id"), F.lit(None).cast("string")).alias("contrat"), F.col("source").alias("s_source"), "famille_cpv", "mediane_log_famille", "ecart_log_famille", "ecart_normalise_famille"), "id")
    rows = _join(rows, usual, ["famille_cpv"]).join(wrong, ["contrat", "s_source"], "left")
    own = F.col("mediane_log_famille").isNotNull() & (F.col("ecart_log_famille") > 0)
    implied = 1.349 * (F.col("niveau_faux") - F.when(own, F.col("mediane_log_famille")).otherwise(F.col("med_usuelle"))) / F.when(own, F.col("ecart_log_famille")).otherwise(F.col("ecart_usuel"))
    gap = F.abs(implied - F.col("ecart_normalise_famille"))
    follows = F.coalesce(gap <= F.when(own, SCORE_TOLERANCE).otherwise(LOOSE_TOLERANCE), F.lit(False))
    judged = rows.groupBy("champ", "id", "etat", "proba").agg(F.max(follows).alias("suit_le_montant"))
    return flagged.filter(F.col("champ") == "montant").withColumn("suit_le_montant", F.lit(False)).unionByName(judged)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_etats(spark, sf_dir).filter(~F.col("suit_le_montant")).select("champ", "id")


QUERIES = {"p2_found": p2_found, "p2_etats": p2_etats}
ORACLES: dict[str, str] = {}
