"""Queries of problem 3: notices and the contracts awarded from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ardoise.llm.linkage import ACCEPT, link
from ardoise.session import table


def p3_liens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notice's best candidate with its confidence."""
    return link(table(spark, sf_dir, "avis"), table(spark, sf_dir, "marches"), table(spark, sf_dir, "verdicts_rapprochement"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_liens(spark, sf_dir).filter(f"confiance >= {ACCEPT}").select("idweb", "marche_id")


QUERIES = {"p3_found": p3_found, "p3_liens": p3_liens}
ORACLES: dict[str, str] = {}
