"""Per-key aggregates when a few keys hold most rows: multi-level tree aggregation.

Rows are cut into chunks of fixed size inside each input partition and combined there (Spark's
map-side combine).  The chunks of all partitions are numbered through, and their partial states meet
in rounds of a fixed fan-in: the node of a chunk is its number divided by the fan-in, again and again,
until at most ``fan_in`` nodes are left.  The group of one round is (key, node), so no group ever
receives more than ``fan_in`` partial states of one key, and the rounds number log(chunks) to the
base ``fan_in``.  How many chunks there are tells a count that reads no column.

Defined results: a null key is a key of its own; an empty table gives no row; clashing or extra
columns are never touched, only the named key and value are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 20
FAN_IN = 64

# How a state of each aggregate merges; ``n`` counts rows.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _layout(df: DataFrame, chunk_rows: int) -> tuple[int, int, int]:
    """(rows, partitions, chunks of the largest partition): a count that reads no column."""
    sizes = df.select(F.spark_partition_id().alias("_p")).groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    one = sizes.agg(F.sum("n").alias("n"), (F.max("_p") + 1).alias("p"), F.max("n").alias("m")).first()
    return int(one.n or 0), int(one.p or 1), max(1, -(-int(one.m or 0) // chunk_rows))


def _tree(df: DataFrame, key: Column, values: dict[str, tuple[str, Column]], chunk_rows: int, fan_in: int) -> tuple[DataFrame, int]:
    rows, parts, chunks = _layout(df, chunk_rows)
    position = F.monotonically_increasing_id()
    first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    chunk = F.shiftright(F.col("_position").bitwiseAND((1 << 33) - 1), int(math.log2(chunk_rows)))
    level = (
        df.select(key.alias("_cle"), *[c.alias(f"_v{i}") for i, (_, c) in enumerate(values.values())], position.alias("_position"))
        .withColumn("_noeud", F.shiftright("_position", 33) * chunks + chunk)
        .groupBy("_cle", "_noeud")
        .agg(*[first[kind](f"_v{i}").alias(f"_v{i}") for i, (kind, _) in enumerate(values.values())])
    )
    merged = [MERGE[kind](f"_v{i}").alias(f"_v{i}") for i, (kind, _) in enumerate(values.values())]
    nodes = parts * chunks
    while nodes > fan_in:
        level = level.withColumn("_noeud", F.expr(f"_noeud div {fan_in}")).groupBy("_cle", "_noeud").agg(*merged)
        nodes = math.ceil(nodes / fan_in)
    final = level.groupBy("_cle").agg(*merged)
    return final.select(F.col("_cle").alias("cle"), *[F.col(f"_v{i}").alias(name) for i, name in enumerate(values)]), rows


def tree_aggregate(df: DataFrame, key: Column, values: dict[str, tuple[str, Column]], chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per key: ``cle`` and one column per entry of ``values``.

    values: name -> (kind, column), kind one of count (of non-null values), sum, min, max.
    """
    return _tree(df, key, values, chunk_rows, fan_in)[0]


def heavy_keys(df: DataFrame, key: Column, share: float, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The non-null keys, as written, that hold at least ``share`` of all rows (rows with a null key count)."""
    per_key, rows = _tree(df, key, {"n": ("count", F.lit(1))}, chunk_rows, fan_in)
    return per_key.filter(F.col("cle").isNotNull() & (F.col("n") >= share * F.lit(rows))).select("cle", "n", F.lit(rows).cast("long").alias("total"))
