"""Filling fixed-capacity containers: first-fit decreasing with a tournament tree.

Sizes are tokens of a public tokenizer, counted over whole texts.  A text longer than the container
is cut into full containers and a rest; no other text is cut.  A full piece is a container of its own
and needs no packing.  The rests, one a text and kind of container, are dealt at random into groups of a
bounded number of texts, so however long the texts are, a group stays bounded; each is packed alone: items by falling size, each into the first
container with room, which a tournament tree over the free capacities finds in logarithmic time.
With thousands of texts in a group the space left is near that of packing everything at once.

Defined results: a null or empty text has no tokens and takes part in no container; repeated rows are
texts of their own, told apart by ``ligne``; a container without positive capacity gets nothing; an
empty table gives no row.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.session import materialise

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
GROUP_TEXTS = 20_000
SCHEMA = "contenant_id int, groupe long, conteneur int, doc_id long, ligne long, morceau int, debut long, tokens int"


def _counter(vocabulary: object, pattern: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        encode = tiktoken.Encoding("ardoise", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return count


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every document.  The vocabulary file (under 1 MB) is read by the driver and broadcast."""
    spec = importlib.util.spec_from_file_location("_public_tokenizers", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    data = documents.sparkSession.sparkContext.broadcast((Path(folder) / vocabulary).read_bytes())
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counter(data, module.PATTERN), "doc_id long, tokens long")


class Tournament:
    """Free capacities of bins under a tree of maxima; finds the first bin with room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        bin_, left = node - self.leaves, best[node] - size
        best[node] = left
        node //= 2
        while node:
            a, b = best[2 * node], best[2 * node + 1]
            best[node] = a if a > b else b
            node //= 2
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; sizes must fall and be at most ``capacity``."""
    tree = Tournament(max(1, len(sizes)), capacity)
    return [tree.place(s) for s in sizes]


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["tokens", "doc_id", "ligne", "morceau"], ascending=[False, True, True, True], kind="stable")
    pdf["conteneur"] = np.array(first_fit_decreasing(pdf["tokens"].tolist(), int(pdf["capacite"].iloc[0])), np.int32)
    return pdf[["contenant_id", "groupe", "conteneur", "doc_id", "ligne", "morceau", "debut", "tokens"]]


def pack(sizes: DataFrame, containers: list[tuple[int, int]], group_texts: int = GROUP_TEXTS) -> DataFrame:
    """One row per piece: its container (``contenant_id``, ``groupe``, ``conteneur``) and where it starts in its text.

    sizes: doc_id, tokens, written (its rows are numbered by place).  containers: (contenant_id, capacite).
    """
    groups = max(1, -(-sizes.count() // group_texts))
    kinds = F.array(*[F.struct(F.lit(i).cast("int").alias("contenant_id"), F.lit(c).cast("long").alias("capacite")) for i, c in containers if c > 0])
    x = sizes.withColumn("ligne", F.monotonically_increasing_id()).filter(F.col("tokens") > 0)
    x = x.withColumn("groupe", F.pmod(F.xxhash64("ligne"), F.lit(groups))).select("doc_id", "ligne", "tokens", "groupe", F.inline(kinds))
    x = x.withColumn("morceau", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / F.col("capacite")).cast("int") - 1)))
    debut = F.col("morceau") * F.col("capacite")
    x = x.select("contenant_id", "capacite", "groupe", "doc_id", "ligne", "morceau", debut.alias("debut"), F.least(F.col("tokens") - debut, F.col("capacite")).cast("int").alias("tokens"))
    full = F.col("tokens") == F.col("capacite")
    rests = x.filter(~full).groupBy("contenant_id", "groupe").applyInPandas(_pack_group, SCHEMA)
    # The containers of a text's full pieces form a group of their own.
    alone = x.filter(full).select("contenant_id", (-1 - F.col("ligne")).alias("groupe"), F.col("morceau").cast("int").alias("conteneur"), "doc_id", "ligne", "morceau", "debut", "tokens")
    return rests.unionByName(alone)


def packed_documents(documents: DataFrame, containers: list[tuple[int, int]]) -> DataFrame:
    if not any(c > 0 for _, c in containers):
        return documents.sparkSession.createDataFrame([], SCHEMA)
    return pack(materialise(token_counts(documents), "tokens"), containers)
