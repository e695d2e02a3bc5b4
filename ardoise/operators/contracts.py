"""Data contracts: rules with a severity, judged in one pass over the table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A row satisfies the rule where ``ok`` is true; null counts as a violation."""

    name: str
    severity: str
    ok: Column


class ContractError(ValueError):
    """A rule of severity error is violated."""


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(regle, severite, violations), one row per rule."""
    counts = df.agg(*[F.count_if(~F.coalesce(r.ok, F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r.name).alias("regle"), F.lit(r.severity).alias("severite"), F.col(f"r{i}").alias("violations")) for i, r in enumerate(rules)])
    return counts.select(F.inline(rows))


def enforce(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` itself if no rule of severity error is violated; raises otherwise.  Warnings never stop."""
    broken = check(df, rules).filter((F.col("severite") == "error") & (F.col("violations") > 0)).collect()
    if broken:
        raise ContractError("; ".join(f"{r.regle}: {r.violations}" for r in broken))
    return df
