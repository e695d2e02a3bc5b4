"""The queries of this subpackage, module by module."""

from __future__ import annotations

from types import ModuleType

from ardoise.llm import leaks_queries, linkage_queries, packing_queries, percentiles_queries, sentences_queries, survivors_queries, variants_queries


def modules() -> list[ModuleType]:
    return [variants_queries, linkage_queries, survivors_queries, percentiles_queries, packing_queries, leaks_queries, sentences_queries]
