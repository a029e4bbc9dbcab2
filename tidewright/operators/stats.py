"""Descriptive statistics and dataset comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import erf, exp, log, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import mean_sd, median_iqr
from .quantiles import percentiles

QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A row per column (and group): count, mean, sd (n - 1), min, exact quartiles, max."""
    table = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    table = table.select(*by, F.col("x.name").alias("column"), F.col("x.v").alias("v"))
    also = {"mean": F.avg("v"), "sd": F.stddev_samp("v"), "min": F.min("v"), "max": F.max("v")}
    found = percentiles(table, "v", QUARTILES, [*by, "column"], also)
    return found.select(*by, "column", "n", "mean", "sd", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def duration_quantiles(df: DataFrame, key: str = "caseid", time: str = "t") -> DataFrame:
    """Quartiles over cases of each case's last time."""
    ends = df.groupBy(key).agg(F.max(time).alias("end"))
    return percentiles(ends, "end", QUARTILES).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n and density over even bins of [low, high]; the last bin holds high, values outside are left out."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("density", F.col("n") / (total * width))


def shared_bounds(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Least and greatest value over two tables."""
    return a.select(column).unionByName(b.select(column)).agg(F.min(column).alias("low"), F.max(column).alias("high"))


def prevalence(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("n_positive"), F.avg(label).alias("prevalence"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def summaries(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean (sd) and median [quartiles] as text."""
    c = F.col(column).cast("double")
    found = percentiles(df, column, QUARTILES, by, {"m": F.avg(c), "s": F.stddev_samp(c)})
    return found.select(*by, mean_sd(F.col("m"), F.col("s")).alias("mean_sd"), median_iqr(F.col("q")).alias("median_iqr"))


def grouped_sums(df: DataFrame, key: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """A column for each group with the sum of its features; of features in several groups the last group counts."""
    owner = {feature: group for group, features in groups.items() for feature in features}
    total: dict[str, Column] = {}
    for group in groups:
        total[group] = F.lit(0.0)
        for feature in (f for f, g in owner.items() if g == group):
            total[group] = total[group] + F.coalesce(F.col(feature), F.lit(0.0))
    return df.select(key, *[v.alias(k) for k, v in total.items()])


def ewm(df: DataFrame, column: str, half_life: float, rows: int | None, key: str = "caseid", pos: str = "pos") -> DataFrame:
    """Exponentially weighted mean and deviation (bias corrected) of the last ``rows`` rows, or of all (None); nulls have no weight.

    No row has its frame: an entity is cut in blocks of ``rows`` rows, and a frame is the end of one block, a running sum from
    behind, and the start of the next, a running sum from the front. Sums are scaled to the newest value in them, which changes
    neither result; values 256 half-lives older than that one don't count beside it.
    """
    span = 256.0 * half_life
    p, v = F.col(pos).cast("double"), F.col(column).cast("double")
    known = v.isNotNull()
    case = Window.partitionBy(key).orderBy(pos)
    place = F.row_number().over(case) - 1
    found = df.withColumn("_place", place).withColumn("_block", F.floor(F.col("_place") / rows) if rows else F.lit(0).cast("long"))
    found = found.withColumn("_span", F.floor(p / span))
    block = Window.partitionBy(key, "_block")
    weight = lambda to: F.pow(F.lit(2.0), (p - to) / half_life)
    parts = lambda w: {"w": w, "ww": w * w, "wv": w * v, "wvv": w * v * v}
    total = lambda w, over: {k: F.coalesce(F.sum(F.when(known, x)).over(over), F.lit(0.0)) for k, x in parts(w).items()}
    own = total(weight(F.col("_span") * span), Window.partitionBy(key, "_block", "_span").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    before = total(weight((F.col("_span") + 1) * span), block.orderBy("_span").rangeBetween(-1, -1))
    scale = weight(F.col("_span") * span)
    power = {"w": scale, "ww": scale * scale, "wv": scale, "wvv": scale}
    front = F.when(known, F.struct(p.alias("at"), *[((own[k] + before[k]) / power[k]).alias(k) for k in own]))
    found = found.withColumn("_front", front).withColumn("_front", F.last("_front", ignorenulls=True).over(block.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))
    start = lambda k: F.coalesce(F.col(f"_front.{k}"), F.lit(0.0))
    sums = {k: start(k) for k in own}
    if rows and rows > 1:
        found = found.withColumn("_newest", F.max(F.when(known, p)).over(block))
        behind = total(weight(F.col("_newest")), block.orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0))
        found = found.withColumn("_back", F.struct("_block", F.col("_newest").alias("at"), *[x.alias(k) for k, x in behind.items()]))
        found = found.withColumn("_back", F.lag("_back", rows - 1).over(case))
        reached = (F.col("_back._block") < F.col("_block")) & (F.col("_back.w") > 0)
        fade = F.pow(F.lit(2.0), (F.col("_back.at") - F.coalesce(F.col("_front.at"), F.col("_back.at"))) / half_life)
        faded = {"w": fade, "ww": fade * fade, "wv": fade, "wvv": fade}
        sums = {k: sums[k] + F.when(reached, F.col(f"_back.{k}") * faded[k]).otherwise(0.0) for k in own}
    found = found.withColumn("_s", F.struct(*[x.alias(k) for k, x in sums.items()]))
    mean = F.col("_s.wv") / F.nullif(F.col("_s.w"), F.lit(0.0))
    var = F.col("_s.wvv") / F.nullif(F.col("_s.w"), F.lit(0.0)) - mean * mean
    fix = F.col("_s.w") * F.col("_s.w") / F.nullif(F.col("_s.w") * F.col("_s.w") - F.col("_s.ww"), F.lit(0.0))
    out = {f"{column}_ewm_mean": mean, f"{column}_ewm_std": F.sqrt(F.greatest(F.lit(0.0), var * fix))}
    return found.withColumns(out).drop("_place", "_block", "_span", "_front", "_newest", "_back", "_s")


def _quantile(p: np.ndarray) -> np.ndarray:
    """Standard normal quantiles by bisection."""
    low, high = np.full(len(p), -9.0), np.full(len(p), 9.0)
    phi = np.vectorize(lambda x: 0.5 * (1 + erf(x / sqrt(2))))
    for _ in range(60):
        mid = (low + high) / 2
        below = phi(mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p of Royston's 1995 approximation (AS R94), for 4 to 5000 values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return float("nan"), float("nan")
    m = _quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    ss, u = float(m @ m), 1 / sqrt(n)
    c = m / sqrt(ss)
    # Royston's polynomials.
    last = c[-1] + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0], u)
    a = np.empty(n)
    if n > 5:
        second = c[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
        phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a[2:-2] = m[2:-2] / sqrt(phi)
        a[1], a[-2] = -second, second
    else:
        phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / sqrt(phi)
    a[0], a[-1] = -last, last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    y = log(max(1e-300, 1 - w))
    if n <= 11:
        g = np.polyval([0.459, -2.273], n)
        if y >= g:
            return w, 0.0
        y = -log(g - y)
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        k = log(n)
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, 0.5 * (1 - erf((y - mu) / sd / sqrt(2)))


def first_by_hash(values: DataFrame, by: str, sample: int) -> DataFrame:
    """At most ``sample`` rows (by, v) of each group, the first by a hash of v; of values with one hash the least first.

    Values are counted first, then the counts of 4,096 ranges of the hash tell where the sample ends, so what is put in order
    is the sample and one range, not a group.
    """
    h = F.xxhash64("v")
    counts = values.groupBy(by, "v").agg(F.count("*").alias("n")).withColumns({"h": h, "range": F.shiftright(h, 52)})
    whole = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy(by, "range").agg(F.sum("n").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(whole), F.lit(0)))
    kept = counts.join(ranges.where(F.col("before") < sample).select(by, "range", "before"), [by, "range"])
    inside = Window.partitionBy(by, "range").orderBy("h", "v").rowsBetween(Window.unboundedPreceding, -1)
    room = sample - F.col("before") - F.coalesce(F.sum("n").over(inside), F.lit(0))
    kept = kept.withColumn("take", F.least(F.col("n"), room)).where("take > 0")
    return kept.select(by, "v", F.explode(F.sequence(F.lit(1).cast("long"), F.col("take"))).alias("_")).drop("_")


def gated_summary(df: DataFrame, column: str, by: str, sample: int = 5000) -> DataFrame:
    """Mean (sd) of groups that pass a normality test (p > 0.05), median [quartiles] of the others.

    The test is defined up to 5000 values, so it has at most ``sample`` of a group, the first by a hash; the summaries
    have all.
    """
    values = df.where(F.col(column).isNotNull()).select(by, F.col(column).cast("double").alias("v"))
    tested = first_by_hash(values, by, sample)

    def test(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame({by: [pdf[by].iloc[0]], "p": [shapiro_wilk(pdf["v"].to_numpy())[1]]})

    kind = dict(df.dtypes)[by]
    p = tested.groupBy(by).applyInPandas(test, f"`{by}` {kind}, p double")
    return summaries(df, column, [by]).join(p, by).select(
        by, F.when(F.col("p") > 0.05, F.col("mean_sd")).otherwise(F.col("median_iqr")).alias("summary"), "p"
    )
