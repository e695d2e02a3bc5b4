"""Queries of problem 6: percentiles of very large numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.llm.percentiles import bounds, merge, quantiles, summarise
from ardoise.session import materialise, table

QUARTILES = {"montant_q1": 0.25, "montant_median": 0.5, "montant_q3": 0.75}
TOLERANCE = 0.05


def p6_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of the amounts of each lot and family."""
    m = table(spark, sf_dir, "marches").filter(F.col("famille_cpv").isNotNull())
    exact = quantiles(m, ["lot", "famille_cpv"], "montant", QUARTILES)
    return exact.select("lot", "famille_cpv", "n", *[F.round(c, 4).alias(c) for c in QUARTILES])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "marches").filter(F.col("famille_cpv").isNotNull())
    names = ["montant_q1", "montant_median"]
    exact = quantiles(m, ["lot", "famille_cpv"], "montant", {n: QUARTILES[n] for n in names})
    said = table(spark, sf_dir, "statistiques_familles").select("lot", "famille_cpv", *[F.col(n).alias(f"publie_{n}") for n in names])
    both = said.join(exact, ["lot", "famille_cpv"])
    pairs = F.array(*[F.struct(F.lit(n).alias("champ"), F.col(f"publie_{n}").alias("publie"), F.col(n).alias("exact")) for n in names])
    x = both.select("lot", "famille_cpv", F.inline(pairs))
    return x.filter(F.col("publie").isNotNull() & (F.abs(F.col("publie") - F.col("exact")) > TOLERANCE * F.abs("exact"))).select("lot", "famille_cpv", "champ")


def p6_union_bornes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the quartiles of each family over all lots, from the per-lot summaries alone."""
    m = table(spark, sf_dir, "marches").filter(F.col("famille_cpv").isNotNull())
    kept = materialise(summarise(m, ["lot", "famille_cpv"], "montant"), "resumes")
    return bounds(merge(kept, ["famille_cpv"]), ["famille_cpv"], QUARTILES)


_EXACT = "select lot, famille_cpv, count(montant) as n, " + ", ".join(f"quantile_cont(montant, {p}) as {c}" for c, p in QUARTILES.items()) + " from marches where famille_cpv is not null and montant is not null group by lot, famille_cpv"
_PARTS = (
    "with x as (select famille_cpv, montant as v, floor(128 * ln(1 + least(abs(montant), 1e300)) / ln(2)) as s from marches where famille_cpv is not null and montant is not null), "
    "p as (select famille_cpv, case when v < 0 then -s - 1 else s end as part, count(*) as n, min(v) as lo, max(v) as hi from x group by all), "
    "c as (select *, sum(n) over (partition by famille_cpv order by part) - n as before, sum(n) over (partition by famille_cpv) as total from p)"
)
_HOLDS = "max({0}) filter (where {1}((total - 1) * {2}) >= before and {1}((total - 1) * {2}) < before + n) as {3}"
QUERIES = {"p6_found": p6_found, "p6_quartiles": p6_quartiles, "p6_union_bornes": p6_union_bornes}
ORACLES = {
    "p6_quartiles": f"select lot, famille_cpv, n, {', '.join(f'round({c}, 4) as {c}' for c in QUARTILES)} from ({_EXACT})",
    "p6_union_bornes": f"{_PARTS} select famille_cpv, cast(max(total) as bigint) as n, {', '.join(_HOLDS.format('lo', 'floor', p, c + '_bas') + ', ' + _HOLDS.format('hi', 'ceil', p, c + '_haut') for c, p in QUARTILES.items())} from c group by famille_cpv",
    "p6_found": " union all ".join(f"select s.lot, s.famille_cpv, '{c}' as champ from statistiques_familles s join ({_EXACT}) e on s.lot = e.lot and s.famille_cpv = e.famille_cpv where s.{c} is not null and abs(s.{c} - e.{c}) > {TOLERANCE} * abs(e.{c})" for c in ("montant_q1", "montant_median")),
}
