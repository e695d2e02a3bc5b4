"""Evaluation of detection rules against a weak label: thresholds, periods, budgets, intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ardoise.functions.columns import half_up, percent

LEAST_GROUP = 30
LARGEST = 1e12
# Draws and seed of the bootstrap.
DRAWS, BOOTSTRAP_SEED = 10_000, 20261021


def judged(df: DataFrame) -> DataFrame:
    """Current rows with family, year, log amount (unrounded score later) and the producer's mark as label."""
    ok = df.filter(F.col("donneesActuelles") & (F.col("montant") > 0) & (F.col("montant") <= LARGEST) & F.col("famille_cpv").isNotNull())
    return ok.select("id", "marche_id", "famille_cpv", "annee", "source", F.round(F.log10("montant"), 4).alias("l"), F.col("montant_anomalie").isNotNull().alias("juste"))


def references(df: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """Median and quartiles of each family with at least ``least`` rows and some spread."""
    r = df.groupBy("famille_cpv").agg(F.count(F.lit(1)).alias("n"), F.median("l").alias("mediane"), F.percentile("l", 0.25).alias("q1"), F.percentile("l", 0.75).alias("q3"))
    return r.filter((F.col("n") >= least) & (F.col("q3") > F.col("q1")))


def scored(df: DataFrame, ref: DataFrame) -> DataFrame:
    """Rows of families with a reference, with their robust score (JOI-2).  A family code has two digits: at most a hundred references."""
    z = (F.col("l") - F.col("mediane")) / ((F.col("q3") - F.col("q1")) / 1.349)
    return df.join(F.broadcast(ref), "famille_cpv").withColumn("z", F.round(z, 6))


def threshold_grid(x: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision and recall of every direction and threshold, in one pass over the rows.

    Each row counts for every threshold it passes: an aggregate over conditional sums, no copy of
    the rows per threshold.
    """
    ways = {"haut": lambda t: F.col("z") > t, "bas": lambda t: F.col("z") < -t, "deux": lambda t: F.abs("z") > t}
    cells = [(w, t) for w in ways for t in thresholds]
    one = x.agg(F.count_if("juste").alias("_justes"), *[a for i, (w, t) in enumerate(cells) for a in (F.count_if(ways[w](t)).alias(f"s{i}"), F.count_if(ways[w](t) & F.col("juste")).alias(f"j{i}"))])
    rows = F.array(*[F.struct(F.lit(w).alias("sens"), F.lit(t).alias("seuil"), F.col(f"s{i}").alias("signales"), F.col(f"j{i}").alias("justes"), F.col("_justes").alias("attendus")) for i, (w, t) in enumerate(cells)])
    y = one.select(F.inline(rows))
    return y.select("sens", "seuil", "signales", "justes", half_up(percent(F.col("justes"), F.col("signales")), 4).alias("precision"), half_up(percent(F.col("justes"), F.col("attendus")), 4).alias("rappel"))


def by_year(x: DataFrame, threshold: float) -> DataFrame:
    flagged = F.col("z") > threshold
    y = x.groupBy("annee").agg(F.count(F.lit(1)).alias("lignes"), F.count_if(flagged).alias("signales"), F.count_if(flagged & F.col("juste")).alias("justes"), F.count_if("juste").alias("attendus"))
    return y.select("annee", "lignes", "signales", "justes", half_up(percent(F.col("justes"), F.col("signales")), 4).alias("precision"), half_up(percent(F.col("justes"), F.col("attendus")), 4).alias("rappel"), half_up(percent(F.col("signales"), F.col("lignes")), 4).alias("part"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """How the median of each family moved between two references, in percent, largest first."""
    a, b = old.select("famille_cpv", F.col("mediane").alias("a")), new.select("famille_cpv", F.col("mediane").alias("b"))
    x = a.join(b, "famille_cpv").select("famille_cpv", half_up(F.lit(100.0) * (F.pow(F.lit(10.0), F.col("b") - F.col("a")) - 1), 2).alias("derive"))
    return x.orderBy(F.abs("derive").desc(), "famille_cpv")


def disagreement(a: DataFrame, b: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """Rows that two calibrations judge differently, joined on ``key`` -- a contract number multiplies rows, a row id does not."""
    x = a.select(*key, (F.col("z") > threshold).alias("fa")).join(b.select(*key, (F.col("z") > threshold).alias("fb")), key)
    y = x.agg(F.count(F.lit(1)).alias("compares"), F.count_if(F.col("fa") & F.col("fb")).alias("deux"), F.count_if(F.col("fa") & ~F.col("fb")).alias("premier"), F.count_if(~F.col("fa") & F.col("fb")).alias("second"))
    return y.withColumn("part_union", half_up(percent(F.col("premier") + F.col("second"), F.col("deux") + F.col("premier") + F.col("second")), 4))


def precision_at(x: DataFrame, score: str, budgets: list[int]) -> DataFrame:
    """Share of true labels among the highest scores, for several budgets; 0 where a budget exceeds the rows."""
    top = x.orderBy(F.desc(score), "id").limit(max(budgets)).withColumn("_rang", F.row_number().over(Window.orderBy(F.desc(score), "id")))
    one = top.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if((F.col("_rang") <= b) & F.col("juste")).alias(f"b{b}") for b in budgets])
    return one.select(F.inline(F.array(*[F.struct(F.lit(b).alias("budget"), F.when(F.col("_n") >= b, half_up(F.lit(100.0) * F.col(f"b{b}") / b, 4)).otherwise(0.0).alias("precision")) for b in budgets])))


# ---- intervals -------------------------------------------------------------------------------


def clopper_pearson(k: int, n: int, level: float = 0.95, steps: int = 50) -> tuple[float, float]:
    """Exact interval of a proportion in percent, by bisection on the log-binomial tail."""
    if n == 0:
        return 0.0, 100.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(n + 1)]

    def tail(p: float, lo: int, hi: int) -> float:
        if p <= 0 or p >= 1:
            return float(lo == 0) if p <= 0 else float(hi == n)
        return sum(math.exp(logs[i] + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(lo, hi + 1))

    half = (1 - level) / 2

    def solve(over) -> float:
        a, b = 0.0, 1.0
        for _ in range(steps):
            m = (a + b) / 2
            a, b = (a, m) if over(m) else (m, b)
        return 100 * (a + b) / 2

    low = 0.0 if k == 0 else solve(lambda p: tail(p, k, n) > half)
    high = 100.0 if k == n else solve(lambda p: tail(p, 0, k) < half)
    return low, high


def exact_intervals(df: DataFrame, k: str, n: str) -> DataFrame:
    """Adds ``bas`` and ``haut``: exact intervals of the counts in columns k and n."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [clopper_pearson(int(a), int(b)) for a, b in zip(pdf[k], pdf[n])]
            yield pdf.assign(bas=[x[0] for x in both], haut=[x[1] for x in both])

    return df.mapInPandas(add, f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, bas double, haut double")


def stratified_bootstrap(labels: dict[str, list[bool]], weights: dict[str, float], draws: int = DRAWS, seed: int = BOOTSTRAP_SEED) -> tuple[float, float, bool]:
    """Interval of a weighted accuracy over judged strata, and whether it is degenerate (no stratum varies).

    The judged sample is small by nature (people judged it), so this is driver arithmetic.
    """
    r, total = np.random.default_rng(seed), sum(weights[s] for s in labels)
    # Of a stratum of n with k right, a draw with replacement has a binomial number of right ones.
    values = sum(weights[s] * r.binomial(len(x), sum(x) / len(x), draws) / len(x) for s, x in sorted(labels.items())) / total
    values = np.sort(values)
    return float(values[int(0.025 * draws)]), float(values[min(draws - 1, int(0.975 * draws))]), bool(values[0] == values[-1])


def weighted_accuracy(labels: dict[str, list[bool]], sizes: dict[str, int], kept: list[str]) -> float | None:
    """Accuracy of the kept strata, weighted by their real sizes; None if one of them has no verdict or all are empty."""
    total = sum(sizes.get(s, 0) for s in kept)
    if not total or any(not labels.get(s) for s in kept):
        return None
    return sum(sizes.get(s, 0) * sum(labels[s]) / len(labels[s]) for s in kept) / total


# ---- models ----------------------------------------------------------------------------------


class IsolationForest:
    """Isolation forest (Liu, Ting and Zhou 2008): trees grown on a bounded sample, scores anywhere."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 42):
        self.trees, self.sample, self.seed, self.forest = trees, sample, seed, []

    def fit(self, rows: np.ndarray) -> IsolationForest:
        r = np.random.default_rng(self.seed)
        size = min(self.sample, len(rows))
        limit = max(1, math.ceil(math.log2(max(size, 2))))
        self.norm = _average_path(size)
        for _ in range(self.trees):
            self.forest.append(_grow(rows[r.choice(len(rows), size, replace=False)], 0, limit, r))
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(rows))
        for tree in self.forest:
            _walk(tree, rows, np.arange(len(rows)), depth)
        return np.power(2.0, -depth / len(self.forest) / max(self.norm, 1e-9))


def _average_path(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, depth: int, limit: int, r: np.random.Generator) -> tuple:
    spread = np.nonzero(x.max(axis=0) > x.min(axis=0))[0] if len(x) else []
    if depth >= limit or len(x) < 2 or not len(spread):
        return (None, depth + _average_path(len(x)))
    f = int(r.choice(spread))
    cut = float(r.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return (f, cut, _grow(x[left], depth + 1, limit, r), _grow(x[~left], depth + 1, limit, r))


def _walk(node: tuple, rows: np.ndarray, at: np.ndarray, depth: np.ndarray) -> None:
    if node[0] is None:
        depth[at] += node[1]
        return
    left = rows[at, node[0]] < node[1]
    _walk(node[2], rows, at[left], depth)
    _walk(node[3], rows, at[~left], depth)


def isolation_scores(df: DataFrame, features: list[str], key: str = "id", sample: int = 256 * 100, seed: int = 42, trees: int = 100, tree_rows: int = 256) -> DataFrame:
    """(key, score): trees grown on a bounded sample of ``sample`` rows, every row scored.

    The sample is the rows with the smallest hash of their key, so it is the same on every run.
    """
    x = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    rows = x.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample).select(*features).toPandas().to_numpy(float)
    if not len(rows):
        return x.select(key, F.lit(None).cast("double").alias("score"))
    forest = df.sparkSession.sparkContext.broadcast(IsolationForest(trees, tree_rows, seed).fit(rows))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "score": forest.value.score(pdf[features].to_numpy(float))})

    return x.mapInPandas(score, f"`{key}` {dict(x.dtypes)[key]}, score double")
