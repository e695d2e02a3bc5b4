"""Queries of problem 7: filling fixed-capacity containers with texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.llm.packing import packed_documents
from ardoise.session import table

# The table of containers is a fixed parameter table; more kinds than this would be a mistake.
MOST_KINDS = 100


def p7_contenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with the container it goes into, for each kind of container."""
    kinds = [(r.contenant_id, r.capacite) for r in table(spark, sf_dir, "contenants").filter("contenant_id is not null and capacite is not null").limit(MOST_KINDS + 1).collect()]
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of container")
    return packed_documents(table(spark, sf_dir, "documents"), kinds)


def p7_bilan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of container: how many are used, and the share of their room that is filled."""
    x = p7_contenants(spark, sf_dir).groupBy("contenant_id", "groupe", "conteneur").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("morceaux"))
    y = x.groupBy("contenant_id").agg(F.count(F.lit(1)).alias("conteneurs"), F.sum("tokens").alias("tokens"), F.sum("morceaux").alias("morceaux"))
    c = table(spark, sf_dir, "contenants")
    return y.join(F.broadcast(c), "contenant_id").select("contenant_id", "capacite", "conteneurs", "morceaux", "tokens", (F.col("tokens") / (F.col("conteneurs") * F.col("capacite"))).alias("remplissage"))


QUERIES = {"p7_contenants": p7_contenants, "p7_bilan": p7_bilan}
ORACLES: dict[str, str] = {}
