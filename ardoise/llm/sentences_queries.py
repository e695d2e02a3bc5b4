"""Queries of problem 9: sentence boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ardoise.llm.sentences import sentences
from ardoise.session import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


QUERIES = {"p9_found": p9_found}
ORACLES: dict[str, str] = {}
