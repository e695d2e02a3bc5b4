"""All query modules of the core, and the flagship query."""

from __future__ import annotations

from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from ardoise.plans import assistant, evaluation, heavy_keys, layers, linking, profiles, search, spikes, texts


def modules() -> list[ModuleType]:
    return [layers, profiles, search, texts, evaluation, linking, assistant, heavy_keys, spikes]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.or_signaux(spark, sf_dir)
