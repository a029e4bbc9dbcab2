"""Bootstrap replicates as groups of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged
from .metrics import areas, by_score, curve_of, on_grid, running_totals


def draws(n_rows: int, replicates: int, df: DataFrame) -> DataFrame:
    """(boot_id, draw, row_no): for each replicate n draws of a row number with replacement, by md5 of boot and draw."""
    boots = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("boot_id")
    grid = df.sparkSession.range(n_rows).select(F.col("id").alias("draw"), boots)
    number = F.conv(F.substring(F.md5(F.concat_ws(":", "boot_id", "draw")), 1, 8), 16, 10).cast("long")
    return grid.select("boot_id", "draw", (number % n_rows).alias("row_no"))


def exact(rows: DataFrame, replicates: int, order: str) -> DataFrame:
    """n-of-n resamples of rows, one group a replicate; rows are numbered by order, a unique number, range by range.

    The numbered rows are written once, and dealt by number to the draws: they are never broadcast.
    """
    n = rows.count()
    numbered = running_totals(rows.withColumn("_one", F.lit(1).cast("long")), order, ["_one"])
    numbered = staged(numbered.withColumn("row_no", n - F.col("cum__one")).drop("_one", "cum__one"), "numbered")
    return draws(n, replicates, rows).join(numbered.hint("shuffle_hash"), "row_no").drop("row_no", "draw")


def poisson(rows: DataFrame, replicates: int, key: str) -> DataFrame:
    """Resamples with Poisson(1) copies of each row, drawn from a hash of boot and key: no numbering, no join."""
    u = (F.pmod(F.xxhash64("boot_id", key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    cut, mass, copies = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(1, 10):
        cut += mass
        copies = copies + (F.col("_u") > cut).cast("int")
        mass /= k
    boots = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("boot_id")
    drawn = rows.select("*", boots).withColumn("_u", u).withColumn("_n", copies).where("_n > 0")
    return drawn.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_u", "_n")


def _curves(resampled: DataFrame) -> DataFrame:
    """The curve of each replicate that has both classes.

    A curve reads the counts of scores several times, so they are written: the replicates are drawn for them only, and the
    plan that the driver holds has them once.
    """
    counts = staged(by_score(resampled, ["boot_id"]), "boot-scores")
    return curve_of(counts, ["boot_id"]).where("n_pos > 0 and n_neg > 0")


def bootstrap_areas(resampled: DataFrame) -> DataFrame:
    """average_precision, auroc and auprc of each replicate that has both classes."""
    return areas(_curves(resampled), ["boot_id"])


def bands(resampled: DataFrame, x: str = "event_recall", y: str = "precision", steps: int = 1000, width: float = 2.0) -> DataFrame:
    """At each place of x: the mean of y over the replicates' curves, and low and high, ``width`` deviations (n) from it."""
    placed = on_grid(_curves(resampled), x, y, steps, ["boot_id"])
    mean, sd = F.avg("y"), F.stddev_pop("y")
    return placed.groupBy("step").agg(mean.alias("mean"), (mean - width * sd).alias("low"), (mean + width * sd).alias("high"))


def spread(replicated: DataFrame, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean, deviation (n) and median over replicates."""
    out = [f(F.col(v)).alias(f"{v}_{name}") for v in values for name, f in (("mean", F.avg), ("sd", F.stddev_pop), ("median", F.median))]
    return replicated.groupBy(*(by or [])).agg(*out)
