"""Case statistics, train / test splits and cross-validation folds, all by case."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows are put in order within so many ranges of their order.
RANGES = 4096


def case_stats(segments: DataFrame) -> DataFrame:
    """Segments and positive segments of each case."""
    return segments.groupBy("caseid").agg(F.count("label").alias("segment_count"), F.sum("label").cast("long").alias("label_count"))


def ranked(df: DataFrame, by: Sequence[str] = (), order: Column | None = None, key: str = "caseid") -> DataFrame:
    """df with place (from 1) and n of each row in its group, in order of key, or of order and key.

    order is a text of hex digits such as hash_order() gives. Rows are counted by RANGES ranges of the order, and put in
    order within a range only; over a whole group only the counts of ranges are ordered.
    """
    by = list(by)
    if order is None:
        bounds = df.groupBy(*by).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
        cut = df.join(bounds, by) if by else df.crossJoin(F.broadcast(bounds))  # one row a group
        width = (F.col("_hi") - F.col("_lo") + 1).cast("double")
        cut = cut.withColumn("_range", F.floor((F.col(key) - F.col("_lo")) / width * RANGES).cast("int")).drop("_lo", "_hi").withColumn("_order", F.lit(""))
    else:
        cut = df.withColumn("_order", order).withColumn("_range", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    sizes = cut.groupBy(*by, "_range").agg(F.count("*").alias("_size"))
    ranges = Window.partitionBy(*by).orderBy("_range")
    sizes = sizes.select(
        *by, "_range",
        F.coalesce(F.sum("_size").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*by)).alias("n"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy("_order", key)
    found = cut.join(sizes, [*by, "_range"]).withColumn("place", F.col("_before") + F.row_number().over(inside))
    return found.drop("_range", "_order", "_before")


def batches(keys: DataFrame, key: str, size: int) -> DataFrame:
    """keys with batch: 0 for the first ``size`` rows in order of key, a whole number; 1 for the next, and so on."""
    return ranked(keys, key=key).withColumn("batch", F.floor((F.col("place") - 1) / size)).drop("place", "n")


def ordered_split(stats: DataFrame, share: float = 0.7, order: Column | None = None) -> DataFrame:
    """split = train for the first int(share * n) cases in order of caseid (or of order, see ranked()), else test."""
    found = ranked(stats, order=order).withColumn("split", F.when(F.col("place") <= F.floor(share * F.col("n")), "train").otherwise("test"))
    return found.drop("place", "n")


def hash_order(seed: int, key: str = "caseid") -> Column:
    """A shuffle that any engine can repeat: the md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))


def split_ratios(stats: DataFrame, group: str = "split") -> DataFrame:
    """Share of segments and share of positives in each group."""
    total = F.sum(F.sum("segment_count")).over(Window.partitionBy())
    return stats.groupBy(group).agg(
        F.count("*").alias("n_cases"),
        F.sum("segment_count").alias("segments"),
        (F.sum("label_count") / F.sum("segment_count")).alias("label_ratio"),
        (F.sum("segment_count") / total).alias("segment_ratio"),
    )


def balanced_split(stats: DataFrame, seeds: int = 100, share: float = 0.7, tolerances: tuple[float, float] = (0.01, 0.005)) -> DataFrame:
    """The shuffled split of least cost among seeds: all are rated in one pass over seeds x cases.

    cost = |segment share of train - share| / tolerance + |difference of label ratios| / tolerance. The search ends at
    the first seed that meets either tolerance; without one, the seed of least cost wins.
    """
    tried = stats.select("*", F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"))

    def dealt(cases: DataFrame) -> DataFrame:
        return ranked(cases, ["seed"], F.md5(F.concat_ws(":", "seed", "caseid"))).withColumn("train", F.col("place") <= F.floor(share * F.col("n")))

    rated = dealt(tried)
    part = lambda c, train: F.sum(F.when(F.col("train") == train, F.col(c)))
    costs = rated.groupBy("seed").agg(
        F.abs(part("segment_count", True) / F.sum("segment_count") - share).alias("a"),
        F.abs(part("label_count", True) / part("segment_count", True) - part("label_count", False) / part("segment_count", False)).alias("b"),
    ).withColumns({"a": F.col("a") / tolerances[0], "b": F.col("b") / tolerances[1]})
    meets = F.min(F.when((F.col("a") < 1) | (F.col("b") < 1), F.col("seed"))).over(Window.partitionBy())
    best = F.min_by("seed", F.struct(F.col("a") + F.col("b"), "seed"))
    chosen = costs.withColumn("stop", meets).where(F.col("stop").isNull() | (F.col("seed") <= F.col("stop"))).agg(best.alias("seed"))
    return dealt(stats.crossJoin(F.broadcast(chosen))).select(  # one row
        *stats.columns, "seed", F.when(F.col("train"), "train").otherwise("test").alias("split")
    )


def folds(stats: DataFrame, k: int = 3, order: Column | None = None) -> DataFrame:
    """cv_split = cv_0.. of the train cases in order, sizes as even as can be with the first ones larger; else test."""
    found = ranked(stats, ["split"], order)
    place, n = F.col("place") - 1, F.col("n")
    small, large = F.floor(n / k), n % k
    number = _fold(place, small, large)
    return found.withColumn("cv_split", F.when(F.col("split") == "train", F.concat(F.lit("cv_"), number.cast("string"))).otherwise("test")).drop("place", "n")


def _fold(place: Column, small: Column, large: Column) -> Column:
    """The fold of a place from 0: the first ``large`` folds have small + 1 places, the others small."""
    head = large * (small + 1)
    return F.when(place < head, F.floor(place / (small + 1))).otherwise(large + F.floor((place - head) / F.greatest(small, F.lit(1))))


def fold_search(stats: DataFrame, k: int = 3, seeds: int = 100, tolerances: tuple[float, float] = (0.01, 0.005), crossed: bool = True) -> DataFrame:
    """seed and fold of each case: the shuffle of least cost among seeds, all rated in one pass over seeds x cases.

    A fold's costs are |share of segments - a| / tolerance and |label ratio - b| / tolerance; with ``crossed`` a is the
    label ratio of all and b is 1, as published results have it, without it 1 / k and the label ratio. The search ends at
    the first seed whose costs of either kind are all below 1; among the seeds up to it the least sum wins, then the first.
    """
    tried = stats.select("*", F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"))
    tried = ranked(tried, ["seed"], F.md5(F.concat_ws(":", "seed", "caseid")))
    tried = tried.withColumn("fold", _fold(F.col("place") - 1, F.floor(F.col("n") / k), F.col("n") % k).cast("int")).drop("place", "n")
    parts = tried.groupBy("seed", "fold").agg(F.sum("segment_count").alias("s"), F.sum("label_count").alias("l"))
    every = Window.partitionBy("seed")
    ratio = F.sum("l").over(every) / F.sum("s").over(every)
    a, b = (ratio, F.lit(1.0)) if crossed else (F.lit(1.0 / k), ratio)
    parts = parts.select("seed", (F.abs(F.col("s") / F.sum("s").over(every) - a) / tolerances[0]).alias("a"), (F.abs(F.col("l") / F.col("s") - b) / tolerances[1]).alias("b"))
    costs = parts.groupBy("seed").agg((F.sum("a") + F.sum("b")).alias("cost"), ((F.max("a") < 1) | (F.max("b") < 1)).alias("meets"))
    stop = F.min(F.when(F.col("meets"), F.col("seed"))).over(Window.partitionBy())  # a row a seed
    kept = costs.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("seed") <= F.col("stop")))
    chosen = kept.agg(F.min_by("seed", F.struct(F.round("cost", 9), "seed")).alias("chosen"))
    return tried.join(F.broadcast(chosen), F.col("seed") == F.col("chosen")).drop("chosen")


def search_folds(stats: DataFrame, k: int = 3, seeds: int = 200, tolerances: tuple[float, float] = (0.01, 0.005), crossed: bool = True) -> dict[int, int]:
    """Fold of each train case by a seeded search on the driver over one row a case; fold_search() is the distributed form.

    The search ends at the first seed whose costs of either kind are all below 1.

    With ``crossed`` the segment share is held against the global label ratio and the label ratio against the train
    segment share, as published results did; without, against 1 / k and the global label ratio.
    """
    rows = sorted((r["caseid"], r["segment_count"], r["label_count"]) for r in stats.where("split = 'train'").collect())
    table = np.array(rows, np.int64).reshape(-1, 3)
    segments, labels = max(1, table[:, 1].sum()), table[:, 2].sum()
    want = (labels / segments, 1.0) if crossed else (1 / k, labels / segments)
    best: tuple[float, list[np.ndarray]] | None = None
    for seed in range(1, seeds + 1):
        order = np.random.RandomState(seed).permutation(len(table))  # noqa: NPY002
        parts = np.array_split(order, k)
        a = [abs(table[p, 1].sum() / segments - want[0]) / tolerances[0] for p in parts]
        b = [abs(table[p, 2].sum() / max(1, table[p, 1].sum()) - want[1]) / tolerances[1] for p in parts]
        if best is None or sum(a) + sum(b) < best[0]:
            best = sum(a) + sum(b), parts
        if max(a) < 1 or max(b) < 1:
            break
    return {int(table[i, 0]): fold for fold, part in enumerate(best[1] if best else []) for i in part}
