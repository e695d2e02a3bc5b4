"""Scores of atypical rows: the bench of methods that a price rule is held against.

Every score grows with how atypical a row is.  Models are fitted either by aggregates over all rows or
on a bounded sample (``SAMPLE`` rows with the smallest hashes of their key, the same on every run); all
rows are scored.

Defined results: missing features count as 0; a feature without spread is left as it is; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 4_096
# Settings of the bench.
CENTRES, NEIGHBOURS, NU, STEPS, SEED = 12, 20, 0.05, 20, 42


def _filled(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def scaled(df: DataFrame, features: list[str], robust: bool) -> DataFrame:
    """The features centred and divided by their spread: mean and deviation, or median and quartiles."""
    x = _filled(df, features)
    if robust:
        one = x.agg(*[F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(c) for c in features]).first()
        at = {c: (one[c][1], one[c][2] - one[c][0]) if one[c] else (0.0, 1.0) for c in features}
    else:
        one = x.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
        at = {c: (one[f"m_{c}"] or 0.0, one[f"s_{c}"]) for c in features}
    return x.withColumns({c: (F.col(c) - float(m)) / float(s or 1.0) for c, (m, s) in at.items()})


def sample(df: DataFrame, features: list[str], key: str = "id", size: int = SAMPLE) -> np.ndarray:
    rows = df.orderBy(F.xxhash64(key, F.lit(SEED)), key).limit(size).select(*features).toPandas()
    return rows.to_numpy(float).reshape(len(rows), len(features))


def _square(terms: list[Column]) -> Column:
    return sum((t * t for t in terms), F.lit(0.0))


def kmeans_scores(df: DataFrame, features: list[str], key: str = "id", centres: int = CENTRES) -> DataFrame:
    """Distance to the nearest of some centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    if df.isEmpty():
        return df.select(key, F.lit(None).cast("double").alias("score"))
    model = KMeans(k=centres, seed=SEED, featuresCol="_v").fit(VectorAssembler(inputCols=features, outputCol="_v").transform(df))
    near = F.least(*[_square([F.col(c) - float(v) for c, v in zip(features, m, strict=True)]) for m in model.clusterCenters()], F.lit(float("inf")))
    return df.select(key, F.sqrt(near).alias("score"))


def reconstruction_scores(df: DataFrame, features: list[str], key: str = "id", axes: int = 2) -> DataFrame:
    """Squared error of reconstruction from the first principal axes; covariances come from one aggregate."""
    covariance = _covariance(df, features)
    if covariance is None:
        return df.select(key, F.lit(None).cast("double").alias("score"))
    mean, c = covariance
    pc = np.linalg.eigh(c)[1][:, ::-1][:, :axes]
    gap = [F.col(f) - float(m) for f, m in zip(features, mean, strict=True)]
    on = [sum((g * float(pc[i, j]) for i, g in enumerate(gap)), F.lit(0.0)) for j in range(axes)]
    return df.select(key, _square([g - sum((p * float(pc[i, j]) for j, p in enumerate(on)), F.lit(0.0)) for i, g in enumerate(gap)]).alias("score"))


def _covariance(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
    n = len(features)
    one = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.covar_samp(features[i], features[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    if one["m0"] is None or one["c0_0"] is None:
        return None
    return np.array([one[f"m{i}"] for i in range(n)]), np.array([[one[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])


def ellipse_scores(df: DataFrame, features: list[str], key: str = "id", kept: float = 0.9) -> DataFrame:
    """Mahalanobis distance from a robust centre: mean and covariance of the ``kept`` share nearest to a first estimate."""
    first = _covariance(df, features)
    if first is None:
        return df.select(key, F.lit(None).cast("double").alias("score"))

    def distance(mean: np.ndarray, c: np.ndarray) -> Column:
        inverse = np.linalg.pinv(c)
        gap = [F.col(f) - float(m) for f, m in zip(features, mean, strict=True)]
        return F.greatest(sum((a * b * float(inverse[i, j]) for i, a in enumerate(gap) for j, b in enumerate(gap)), F.lit(0.0)), F.lit(0.0))

    x = df.withColumn("_d", distance(*first))
    limit = x.agg(F.percentile_approx("_d", kept, 10_000)).first()[0]
    return df.select(key, distance(*(_covariance(x.filter(F.col("_d") <= limit), features) or first)).alias("score"))


def one_class_scores(df: DataFrame, features: list[str], key: str = "id", nu: float = NU, steps: int = STEPS) -> DataFrame:
    """Linear one-class machine: subgradient steps over all rows, each one aggregate; the score is the distance below the plane."""
    w, rho = np.ones(len(features)) / len(features), 0.0
    for t in range(1, steps + 1):
        side = sum((F.col(c) * float(v) for c, v in zip(features, w, strict=True)), F.lit(0.0))
        out = side < rho
        one = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(out).alias("k"), *[F.sum(F.when(out, F.col(c))).alias(f"s{i}") for i, c in enumerate(features)]).first()
        if not one.n:
            break
        grad = w - np.array([one[f"s{i}"] or 0.0 for i in range(len(features))]) / (nu * one.n)
        w, rho = w - grad / (t + 1), rho - (one.k / (nu * one.n) - 1) / (t + 1)
    side = sum((F.col(c) * float(v) for c, v in zip(features, w, strict=True)), F.lit(0.0))
    return df.select(key, (F.lit(float(rho)) - side).alias("score"))


def _nearest(rows: np.ndarray, known: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distances and numbers of the k nearest known points; of points that are among the known, not themselves."""
    d = np.sqrt(np.maximum((rows**2).sum(1)[:, None] - 2 * rows @ known.T + (known**2).sum(1)[None], 0.0))
    if same:
        np.fill_diagonal(d, np.inf)
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(d, at, 1), at


class LocalOutliers:
    """Local outlier factor (Breunig, Kriegel, Ng and Sander 2000) of any row against a bounded sample."""

    def __init__(self, known: np.ndarray, k: int = NEIGHBOURS):
        self.known, self.k = known, min(k, len(known) - 1)
        d, at = _nearest(known, known, self.k, True)
        self.reach = d.max(axis=1)
        self.density = self._density(d, at)

    def _density(self, d: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / np.maximum(np.maximum(d, self.reach[at]).mean(axis=1), 1e-10)

    def score(self, rows: np.ndarray, block: int = 512) -> np.ndarray:
        out = []
        for a in range(0, len(rows), block):
            d, at = _nearest(rows[a : a + block], self.known, self.k, False)
            out.append(self.density[at].mean(axis=1) / self._density(d, at))
        return np.concatenate(out) if out else np.zeros(0)


def local_outlier_scores(df: DataFrame, features: list[str], key: str = "id", size: int = SAMPLE) -> DataFrame:
    known = sample(df, features, key, size)
    if len(known) < 3:
        return df.select(key, F.lit(None).cast("double").alias("score"))
    model = df.sparkSession.sparkContext.broadcast(LocalOutliers(known))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "score": model.value.score(pdf[features].to_numpy(float))})

    return df.select(key, *features).mapInPandas(score, f"`{key}` {dict(df.dtypes)[key]}, score double")
