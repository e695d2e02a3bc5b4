"""Exact percentiles per group by bisection, and mergeable summaries with bounded error.

Every pass keeps a value interval per group and wanted rank, counts the rows below the midpoints of
that interval, and narrows it to the part that holds the rank.  One pass uses many midpoints at once
(a k-ary bisection), and counts are combined on the map side, so a hot group sends counts, not rows:

- pass 1 cuts the whole number line at fixed midpoints, ``PER_OCTAVE`` to a doubling; the counts,
  with the least and largest value of each part, are the *summary*.  Summaries of days, lots or
  partitions merge by addition; any percentile of a union then lies between the bounds of one part,
  at most 2 ** (1 / PER_OCTAVE) apart (amounts under one: 1 / PER_OCTAVE * 0.7 apart);
- further passes cut only the parts that hold a wanted rank, into ``FAN`` parts each, until a part
  has at most ``LEAF`` rows or one single value;
- the last pass counts each distinct value of those parts and reads the ranks off.

Percentiles are the linearly interpolated ones.  Defined results: null and NaN values do not count;
a null group is a group; a group without values gives no row; ties are counted, not sorted; an
empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ardoise.session import materialise, small

PER_OCTAVE = 128
FAN = 256
LEAF = 4096


def _part(x: Column) -> Column:
    """Number of the part of the line that holds x; grows with x."""
    size = F.log2(1 + F.least(F.abs(x), F.lit(1e300))) * PER_OCTAVE
    return F.when(x < 0, -F.floor(size) - 1).otherwise(F.floor(size)).cast("long")


def summarise(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, part, n, lo, hi): what is kept of each group.  Merge by summing n over any union."""
    x = F.col(value).cast("double")
    return df.select(*groups, x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x")).groupBy(*groups, _part(F.col("_x")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))


def merge(summary: DataFrame, groups: list[str]) -> DataFrame:
    """The summary of coarser groups (a union of lots, say), from the summaries kept."""
    return summary.groupBy(*groups, "part").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _wanted(summary: DataFrame, groups: list[str], ps: list[float]) -> DataFrame:
    """Each wanted rank with the part that holds it: groups, part, rank, before, n, lo, hi, total."""
    w = Window.partitionBy(*groups)
    total = F.sum("n").over(w)
    before = F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("total") - 1) * F.lit(p)), F.ceil((F.col("total") - 1) * F.lit(p))) for p in ps])))
    x = summary.withColumn("total", total).withColumn("before", before)
    held = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    return x.withColumn("rank", F.explode(held)).select(*groups, "part", "rank", "before", "n", "lo", "hi", "total")


def bounds(summary: DataFrame, groups: list[str], ps: dict[str, float]) -> DataFrame:
    """(groups, n, <name>_bas, <name>_haut): bounds of each percentile from a summary alone."""
    wanted = _wanted(summary, groups, list(ps.values()))
    out = []
    for name, p in ps.items():
        low, high = F.floor((F.col("total") - 1) * F.lit(p)), F.ceil((F.col("total") - 1) * F.lit(p))
        out += [F.min(F.when(F.col("rank") == low, F.col("lo"))).alias(f"{name}_bas"), F.max(F.when(F.col("rank") == high, F.col("hi"))).alias(f"{name}_haut")]
    return wanted.groupBy(*groups).agg(F.max("total").alias("n"), *out)


def _same(keys: list[str], right: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{right}{k}"))
    return on


def quantiles(df: DataFrame, groups: list[str], value: str, ps: dict[str, float], leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(groups, n, one column per name): exact interpolated percentiles of each group."""
    # Own names inside, so that no group column can clash with a column of ours.
    inner = [f"_g{i}" for i in range(len(groups))]
    x = df.select(*[F.col(g).alias(k) for g, k in zip(groups, inner)], F.col(value).cast("double").alias("_valeur"))
    out = _quantiles(x, inner, "_valeur", {f"_p{i}": p for i, p in enumerate(ps.values())}, leaf, fan)
    return out.select(*[F.col(k).alias(g) for g, k in zip(groups, inner)], "n", *[F.col(f"_p{i}").alias(n) for i, n in enumerate(ps)])


def _quantiles(df: DataFrame, groups: list[str], value: str, ps: dict[str, float], leaf: int, fan: int) -> DataFrame:
    wanted = materialise(_wanted(summarise(df, groups, value), groups, list(ps.values())), "rangs")
    done = wanted.filter("lo = hi").select(*groups, "rank", "total", F.col("lo").alias("valeur"))
    open_ = wanted.filter("lo < hi")
    rows = df.select(*[F.col(g).alias(g) for g in groups], F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x")).withColumn("part", _part(F.col("_x")))
    while True:
        keys = [*groups, "part"]
        parts = small(open_.select(*keys, "lo", "hi", "n").distinct(), "intervalles")
        largest = parts.agg(F.max("n")).first()[0]
        right = parts.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "lo", "hi")
        inside = rows.join(right, _same(keys, "_r_")).drop(*[f"_r_{k}" for k in keys])
        if largest is None or largest <= leaf:
            break
        # One more bisection: every open part into ``fan`` parts between its own least and largest value.
        cut = F.least(F.lit(fan - 1), F.floor((F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * fan))
        rows = materialise(inside.withColumn("part", F.concat_ws("/", F.col("part").cast("string"), F.lpad(cut.cast("string"), 4, "0"))).select(*groups, "part", "_x"), "lignes")
        finer = rows.groupBy(*groups, "part").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).withColumn("_parent", F.regexp_extract("part", "^(.*)/[0-9]+$", 1))
        w = Window.partitionBy(*groups, "_parent").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        finer = finer.withColumn("_cum", F.sum("_n").over(w) - F.col("_n")).select(*[F.col(g).alias(f"_r_{g}") for g in groups], F.col("_parent").alias("_r_part"), F.col("part").alias("_part"), "_n", "_lo", "_hi", "_cum")
        ahead = open_.withColumn("part", F.col("part").cast("string")).join(finer, _same(keys, "_r_"))
        ahead = ahead.filter((F.col("rank") >= F.col("before") + F.col("_cum")) & (F.col("rank") < F.col("before") + F.col("_cum") + F.col("_n")))
        ahead = materialise(ahead.select(*groups, F.col("_part").alias("part"), "rank", (F.col("before") + F.col("_cum")).alias("before"), F.col("_n").alias("n"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "total"), "rangs")
        done = done.unionByName(ahead.filter("lo = hi").select(*groups, "rank", "total", F.col("lo").alias("valeur")))
        open_ = ahead.filter("lo < hi")
    w = Window.partitionBy(*groups, "part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    values = inside.groupBy(*groups, "part", "_x").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cum", F.sum("_n").over(w) - F.col("_n"))
    values = values.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_x", "_n", "_cum")
    last = open_.join(values, _same(keys, "_r_")).filter((F.col("rank") >= F.col("before") + F.col("_cum")) & (F.col("rank") < F.col("before") + F.col("_cum") + F.col("_n")))
    resolved = done.unionByName(last.select(*groups, "rank", "total", F.col("_x").alias("valeur")))
    out = []
    for name, p in ps.items():
        h = (F.col("total") - 1) * F.lit(p)
        low, high = F.max(F.when(F.col("rank") == F.floor(h), F.col("valeur"))), F.max(F.when(F.col("rank") == F.ceil(h), F.col("valeur")))
        out.append((low + (F.max(h) - F.floor(F.max(h))) * (high - low)).alias(name))
    return resolved.groupBy(*groups).agg(F.max("total").alias("n"), *out)
