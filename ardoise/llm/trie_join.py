"""Trie join: all pairs of strings within a bounded edit distance, by sharded tries and Levenshtein automata.

Every indexed string is cut into ``bound + 2`` pieces; a string within ``bound`` edits (insertions,
deletions, substitutions, swaps of neighbours) leaves at least one piece whole at a place shifted by
at most ``bound``, so each piece names a shard and no pair is lost.  A shard builds a trie of its
strings and walks it with the Levenshtein automaton of each probe, whose states are made when first
met.  A shard with many strings is split by hash; its probes then visit every part.

Defined results: nulls and empty strings match nothing; strings shorter than ``least`` match only
themselves; repeated strings count once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ardoise.session import shuffled

SHARD_STRINGS = 20_000
LEAST = 4


class Automaton:
    """Deterministic automaton of one word and a bound; a state is a pair of rows of the distance table."""

    def __init__(self, word: str, bound: int):
        self.word, self.bound, self.moves = word, bound, {}
        self.start = (tuple(min(i, bound + 1) for i in range(len(word) + 1)), None, "")

    def step(self, state: tuple, c: str) -> tuple | None:
        key = (state, c)
        if key not in self.moves:
            row, before, last = state
            w, cap = self.word, self.bound + 1
            new = [min(row[0] + 1, cap)]
            for i in range(1, len(w) + 1):
                d = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (w[i - 1] != c))
                if before is not None and i > 1 and w[i - 1] == last and w[i - 2] == c:
                    d = min(d, before[i - 2] + 1)
                new.append(min(d, cap))
            self.moves[key] = (tuple(new), row, c) if min(new) <= self.bound else None
        return self.moves[key]


def build_trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def search(trie: dict, word: str, bound: int) -> list[tuple[str, int]]:
    """Words of the trie within the bound, with their distance."""
    automaton, out = Automaton(word, bound), []
    stack = [(trie, automaton.start)]
    while stack:
        node, state = stack.pop()
        for c, child in node.items():
            if c == "":
                if state[0][-1] <= bound:
                    out.append((child, state[0][-1]))
            else:
                following = automaton.step(state, c)
                if following is not None:
                    stack.append((child, following))
    return out


def _piece_bounds(n: Column, pieces: int, k: int) -> tuple[Column, Column]:
    return F.floor(n * k / pieces), F.floor(n * (k + 1) / pieces)


def _index_shards(word: Column, pieces: int) -> Column:
    n = F.length(word)
    out = []
    for k in range(pieces):
        a, b = _piece_bounds(n, pieces, k)
        out.append(F.concat_ws(":", n.cast("string"), F.lit(str(k)), word.substr((a + 1).cast("int"), (b - a).cast("int"))))
    return F.array(*out)


def _probe_shards(word: Column, pieces: int, bound: int) -> Column:
    n = F.length(word)
    out = []
    for dn in range(-bound, bound + 1):
        size = n + dn
        for k in range(pieces):
            a, b = _piece_bounds(size, pieces, k)
            for shift in range(-bound, bound + 1):
                at = a + shift
                text = word.substr((at + 1).cast("int"), (b - a).cast("int"))
                out.append(F.when((at >= 0) & (at + b - a <= n) & (size >= 1), F.concat_ws(":", size.cast("string"), F.lit(str(k)), text)))
    return F.array_distinct(F.array_compact(F.array(*out)))


def _search_shards(bound: int):
    """All shards of a bucket: a trie of the indexed words of each, walked by each of its probes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shards: dict[tuple, tuple[list, list]] = {}
        for group, case, part, word, side in zip(pdf["_groupe"], pdf["_case"], pdf["_part"], pdf["_mot"], pdf["_cote"]):
            shards.setdefault((group, case, part), ([], []))[side].append(word)
        found = set()
        for (group, _, _), (words, probes) in shards.items():
            if words and probes:
                trie = build_trie(words)
                found.update((group, p, w, d) for p in probes for w, d in search(trie, p, bound))
        return pd.DataFrame(sorted(found), columns=["groupe", "sonde", "mot", "distance"])

    return run


def trie_join(index: DataFrame, probes: DataFrame, bound: int = 1) -> DataFrame:
    """(groupe, sonde, mot, distance): words of ``index`` within ``bound`` of a word of ``probes``, in the same group.

    Both sides: groupe string, mot string.
    """
    pieces = bound + 2
    i = index.select(F.col("groupe").alias("_groupe"), F.col("mot").alias("_mot")).filter(F.length("_mot") >= LEAST).distinct()
    p = probes.select(F.col("groupe").alias("_groupe"), F.col("mot").alias("_mot")).filter(F.length("_mot") >= LEAST).distinct()
    i = i.withColumn("_case", F.explode(_index_shards(F.col("_mot"), pieces)))
    p = p.withColumn("_case", F.explode(_probe_shards(F.col("_mot"), pieces, bound)))
    parts = shuffled(i.groupBy("_groupe", "_case").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_STRINGS)).cast("int").alias("_parts")))
    i = i.join(parts, ["_groupe", "_case"]).withColumn("_part", F.pmod(F.xxhash64("_mot"), F.col("_parts")).cast("int"))
    p = p.join(parts, ["_groupe", "_case"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    # Small shards travel together: a bucket of shards is one group for Python, told apart inside.
    cols = ["_groupe", "_case", "_part", "_mot", "_cote"]
    both = i.withColumn("_cote", F.lit(0)).select(*cols).unionByName(p.withColumn("_cote", F.lit(1)).select(*cols))
    # The number of buckets follows the number of shards, so that a bucket stays bounded.
    buckets = max(16, -(-parts.count() // 2_000))
    found = both.groupBy(F.pmod(F.xxhash64("_groupe", "_case", "_part"), F.lit(buckets)).alias("_seau")).applyInPandas(_search_shards(bound), "groupe string, sonde string, mot string, distance int")
    return found.distinct()
