"""Distribution shift: covariance, Mahalanobis distance, out-of-distribution share and confidence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import percentiles


def covariance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: mean_{a}, and cov_{a}_{b} (n - 1) of each pair; one pass, partial sums."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    return df.agg(*[F.avg(a).alias(f"mean_{a}") for a in features], *[F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs])


def mahalanobis(df: DataFrame, features: Sequence[str], reference: DataFrame) -> DataFrame:
    """Add distance to the mean of reference, scaled by its covariance.

    The matrix (features squared) is inverted on the driver; the distance is one expression.
    """
    row = covariance(reference, features).first()
    k = len(features)
    matrix = np.array([[row[f"cov_{features[min(i, j)]}_{features[max(i, j)]}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(matrix)
    centred = [F.col(f) - F.lit(float(row[f"mean_{f}"])) for f in features]
    form: Column = F.lit(0.0)
    for i in range(k):
        for j in range(i, k):
            form = form + centred[i] * centred[j] * float(inverse[i, j] * (1 if i == j else 2))
    return df.withColumn("distance", F.sqrt(F.greatest(form, F.lit(0.0))))


def _exceeded(x: Column, limits: Sequence[float], first: int = 0) -> Column:
    """How many of the ascending limits x exceeds, by halving."""
    if not limits:
        return F.lit(first)
    half = len(limits) // 2
    return F.when(x > limits[half], _exceeded(x, limits[half + 1 :], first + half + 1)).otherwise(_exceeded(x, limits[:half], first))


def exceedance(reference: DataFrame, other: DataFrame, levels: Sequence[int], column: str = "distance") -> DataFrame:
    """Share of other above each percentile of reference, with the percentile; no rows if reference has no values.

    The limits, one number a level, are read first. A row is put once in the bucket of the limits that it exceeds; what is
    paired with the levels is a count a bucket.
    """
    levels = sorted(levels)
    limits = percentiles(reference, column, [q / 100 for q in levels]).first()["q"] or []
    each = reference.sparkSession.createDataFrame([(k, level, limit) for k, (level, limit) in enumerate(zip(levels, limits))], "k int, level int, limit double")
    known = other.where(F.col(column).isNotNull())
    counts = known.groupBy(_exceeded(F.col(column), limits).alias("exceeded")).agg(F.count("*").alias("n"))
    pairs = counts.crossJoin(F.broadcast(each))  # buckets and levels, a few dozen of each
    share = F.sum(F.when(F.col("exceeded") > F.col("k"), F.col("n")).otherwise(0)) / F.sum("n")
    return pairs.groupBy("level", "limit").agg(share.alias("share_above"))


def confidence(df: DataFrame, limit: float, column: str = "distance") -> DataFrame:
    """0 to 100: within the limit the nearest has 100 and the farthest 90, beyond it the nearest 90 and the farthest 0."""
    d = F.col(column)
    sides = df.agg(
        *[f(F.when(cond, d)).alias(name) for name, f, cond in (
            ("_in0", F.min, d <= limit), ("_in1", F.max, d <= limit), ("_out0", F.min, d > limit), ("_out1", F.max, d > limit))]
    )
    part = lambda lo, hi: F.coalesce((F.col(hi) - d) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0)), F.lit(1.0))
    value = F.when(d <= limit, 90 + 10 * part("_in0", "_in1")).otherwise(90 * part("_out0", "_out1"))
    return df.crossJoin(F.broadcast(sides)).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))).drop(
        "_in0", "_in1", "_out0", "_out1"
    )


def fixed_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same each time: the first by md5 of seed and key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key).limit(n)
