"""Masking, trimming, smoothing and filling of gridded series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BuildConfig
from ..functions.series import back_over, lerp, over
from .resample import resample

PRESSURES = ("mbp", "sbp", "dbp")


def mask_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Values outside [low, high] become null."""
    return df.withColumn(column, F.when(F.col(column).between(low, high), F.col(column)))


def trim_edges(df: DataFrame, column: str, key: str = "caseid", pos: str = "pos") -> DataFrame:
    """Drop each entity's rows before the first and after the last value of column; pos begins at 0 again."""
    one = Window.partitionBy(key)
    there = F.when(F.col(column).isNotNull(), F.col(pos))
    bounds = {"_first": F.min(there).over(one), "_last": F.max(there).over(one)}
    kept = df.withColumns(bounds).where(F.col(pos).between(F.col("_first"), F.col("_last")))
    return kept.withColumn(pos, F.col(pos) - F.col("_first")).drop("_first", "_last")


def rolling_mean(df: DataFrame, columns: Sequence[str], rows: int, key: str = "caseid", pos: str = "pos") -> DataFrame:
    """Mean of the values that are not null among the last ``rows`` rows."""
    frame = over(key, pos).rowsBetween(-(rows - 1), 0)
    return df.withColumns({c: F.avg(c).over(frame) for c in columns})


def reject_peaks(df: DataFrame, column: str, rows: int, limit: float, key: str = "caseid", pos: str = "pos") -> DataFrame:
    """Null where a value differs from the centred mean of 2 * rows + 1 rows by more than limit."""
    mean = F.avg(column).over(over(key, pos).rowsBetween(-rows, rows))
    return df.withColumn(column, F.when(F.abs(F.col(column) - mean) <= limit, F.col(column)))


def interpolate(df: DataFrame, columns: Sequence[str], key: str = "caseid", pos: str = "pos") -> DataFrame:
    """Linear by row; after the last value its repeats, before the first one null."""
    before, after = over(key, pos).rowsBetween(Window.unboundedPreceding, 0), back_over(key, pos)
    marked = {f"_at_{c}": F.when(F.col(c).isNotNull(), F.col(pos)) for c in columns}
    left = {f"_{side}0_{c}": F.last(x, True).over(before) for c in columns for side, x in (("x", f"_at_{c}"), ("y", c))}
    right = {f"_{side}1_{c}": F.last(x, True).over(after) for c in columns for side, x in (("x", f"_at_{c}"), ("y", c))}
    filled = {c: lerp(F.col(pos), *[F.col(f"_{k}_{c}") for k in ("x0", "y0", "x1", "y1")]) for c in columns}
    return df.withColumns(marked).withColumns(left).withColumns(right).withColumns(filled).drop(*marked, *left, *right)


def fill(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def preprocess(df: DataFrame, config: BuildConfig, main: str = "mbp", tie: str | None = None) -> DataFrame:
    """From raw rows (caseid, t, signals) to a dense, smooth, gap-free grid."""
    signals = list(config.signals)
    grid = resample(df, config.step, signals, config.how, tie=tie)
    kept = trim_edges(mask_range(grid, main, config.low, config.high), main)
    kept = fill(kept, [c for c in config.not_smoothed if c in signals])
    smooth = rolling_mean(kept, [c for c in signals if c not in config.not_smoothed], config.smooth_rows)
    return fill(interpolate(smooth, [c for c in signals if c in PRESSURES]), signals)
