"""Queries of problem 4: the best representative of each duplicate group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ardoise.llm.survivors import fused, survivors
from ardoise.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "marches")).select("id_groupe", "id")


def p4_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each award's record built field by field from the latest values."""
    return fused(table(spark, sf_dir, "marches"), ["acheteur_siret", "titulaire_siret", "titulaire_nom", "objet", "nature", "code_cpv", "montant", "duree_mois", "offres_recues", "date_notification"])


QUERIES = {"p4_found": p4_found, "p4_fusion": p4_fusion}
ORACLES: dict[str, str] = {}
