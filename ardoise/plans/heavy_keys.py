"""Queries of problem 5: a few keys holding most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.operators.heavy_keys import heavy_keys, tree_aggregate
from ardoise.session import table

SHARE = 0.03
FIELDS = (("marches", "acheteur_siret"), ("recherche", "titulaire_nom"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [heavy_keys(table(spark, sf_dir, t), F.col(c), SHARE).select(F.lit(c).alias("champ"), "cle") for t, c in FIELDS]
    return found[0].unionByName(found[1])


def p5_par_cle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-key counts, sums and bounds of the amounts, for every key of both fields."""
    out = []
    for t, c in FIELDS:
        cents = F.round(F.when(F.abs("montant") < 1e15, F.col("montant")) * 100).cast("decimal(20,0)")
        values = {"lignes": ("count", F.lit(1)), "montants": ("count", F.col("montant")), "total_centimes": ("sum", cents), "plus_petit": ("min", F.col("montant")), "plus_grand": ("max", F.col("montant"))}
        out.append(tree_aggregate(table(spark, sf_dir, t), F.col(c), values).withColumn("total_centimes", F.col("total_centimes").cast("double")).select(F.lit(c).alias("champ"), "*"))
    return out[0].unionByName(out[1])


def _found(t: str, c: str) -> str:
    return f"select '{c}' as champ, {c} as cle from {t} where {c} is not null group by {c} having count(*) >= {SHARE} * (select count(*) from {t})"


def _per_key(t: str, c: str) -> str:
    return (
        f"select '{c}' as champ, {c} as cle, count(*) as lignes, count(montant) as montants, "
        "cast(sum(cast(round(case when abs(montant) < 1e15 then montant end * 100) as decimal(20,0))) as double) as total_centimes, "
        f"min(montant) as plus_petit, max(montant) as plus_grand from {t} group by {c}"
    )


QUERIES = {"p5_found": p5_found, "p5_par_cle": p5_par_cle}
ORACLES = {
    "p5_found": " union all ".join(_found(*x) for x in FIELDS),
    "p5_par_cle": " union all ".join(_per_key(*x) for x in FIELDS),
}
