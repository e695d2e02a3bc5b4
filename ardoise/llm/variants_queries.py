"""Queries of problem 1: variant spellings of names typed by people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ardoise.llm.variants import spellings, variant_pairs
from ardoise.session import table


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = table(spark, sf_dir, "marches").select(F.lit("acheteur_nom").alias("champ"), F.col("acheteur_nom").alias("nom"))
    return buyers.unionByName(table(spark, sf_dir, "recherche").select(F.lit("titulaire_nom").alias("champ"), F.col("titulaire_nom").alias("nom")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(_fields(spark, sf_dir))


def p1_graphies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name with its entity and the number of spellings of that entity."""
    s = spellings(_fields(spark, sf_dir))
    return s.withColumn("graphies", F.count(F.lit(1)).over(Window.partitionBy("champ", "entite")))


QUERIES = {"p1_found": p1_found, "p1_graphies": p1_graphies}
ORACLES: dict[str, str] = {}
