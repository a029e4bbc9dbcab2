"""Sparse tracks to one row per entity and second, and on to a dense regular grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import over


def tracks_to_wide(df: DataFrame, keys: Sequence[str], track: str, value: str, names: Mapping[str, str]) -> DataFrame:
    """One column for each track (source name to column name), null in the rows of other tracks; no shuffle."""
    columns = {c: F.when(F.col(track) == t, F.col(value)) for t, c in names.items()}
    return df.select(*keys, *[v.alias(c) for c, v in columns.items()])


def first_of_each_name(df: DataFrame) -> DataFrame:
    """df without the columns whose name an earlier column has."""
    places = {}
    for k, c in enumerate(df.columns):
        places.setdefault(c, k)
    numbered = df.toDF(*[f"_{k}" for k in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{k}").alias(c) for c, k in places.items()])


def union_sparse(*tables: DataFrame) -> DataFrame:
    """Union by name; a column that a table lacks is null in its rows."""
    first, *others = tables
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def bucket_first(df: DataFrame, values: Sequence[str], key: str = "caseid", time: str = "t", tie: str | None = None) -> DataFrame:
    """One row per entity and whole second (half-even rounding): the earliest value that is not null of each column."""
    order = F.struct(time, *([tie] if tie else []))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in values]
    return df.groupBy(key, F.bround(time).cast("long").alias("second")).agg(*first)


def resample(
    df: DataFrame,
    step: int,
    values: Sequence[str],
    how: str = "last",
    key: str = "caseid",
    time: str = "t",
    tie: str | None = None,
) -> DataFrame:
    """A dense grid per entity, anchored at its first row: key, pos (from 0), t and the values.

    ``last`` takes the latest value that is not null of [t0 + b * step, t0 + (b + 1) * step), ``median`` the median of
    (t0 + (b - 1) * step, t0 + b * step]; both are labelled t0 + b * step. Buckets without rows are null. Everything is
    dealt by the entity once: the grid is filled from the gap to the next bucket, without a join.
    """
    start = F.min(time).over(Window.partitionBy(key))
    offset = (F.col(time) - F.col("_t0")) / step
    bucket = F.floor(offset) if how == "last" else F.ceil(offset)
    rows = df.withColumn("_t0", start).withColumn("_b", bucket.cast("long"))
    if how == "last":
        order = F.struct(time, *([tie] if tie else []))
        taken = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in values]
    elif how == "median":
        taken = [F.median(c).alias(c) for c in values]
    else:
        raise ValueError(f"no such way to resample: {how}")
    filled = rows.groupBy(key, "_b").agg(F.min("_t0").alias("_t0"), *taken)
    following = F.lead("_b").over(Window.partitionBy(key).orderBy("_b"))
    filled = filled.withColumn("_to", F.coalesce(following - 1, F.col("_b")))
    grid = filled.withColumn("pos", F.explode(F.sequence("_b", "_to")))
    own = F.col("pos") == F.col("_b")
    return grid.select(key, "pos", (F.col("_t0") + F.col("pos") * step).alias(time), *[F.when(own, F.col(c)).alias(c) for c in values])


def decimate(df: DataFrame, stride: int, key: str = "caseid", pos: str = "pos") -> DataFrame:
    """Every stride-th row of each entity, beginning with the first."""
    return df.withColumn("_n", F.row_number().over(over(key, pos))).where((F.col("_n") - 1) % stride == 0).drop("_n")


def time_slice(df: DataFrame, low: int, high: int, key: str = "caseid", time: str = "t") -> DataFrame:
    """Rows from low to high seconds after the entity's first row, times counted from low."""
    start = F.min(time).over(Window.partitionBy(key))
    return df.withColumn(time, F.col(time) - start).where(F.col(time).between(low, high)).withColumn(time, F.col(time) - low)
