"""Queries of problem 8: evaluation texts leaking into training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ardoise.llm.leaks import leaks
from ardoise.session import table

# A third of the item; the slack is for a changed word at either end of the passage.
LEAST = 0.30
# Everything that was found, short quotes too.
ANY = 0.05


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "items_evaluation"), LEAST).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared passage with the part of the item that it covers."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "items_evaluation"), ANY)


QUERIES = {"p8_found": p8_found, "p8_passages": p8_passages}
ORACLES: dict[str, str] = {}
