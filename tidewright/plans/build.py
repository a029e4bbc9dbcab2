"""The dataset build as one plan, and the stand-in series of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BuildConfig
from ..operators import events, preprocess, segments
from ..sources.tables import table

#: The stand-in: a case is a user, the pressure is the event's value, a grid step is six hours.
STAND_IN = BuildConfig(
    signals=("mbp",),
    half_times=(43_200, 86_400, 172_800),
    step=21_600,
    observation=172_800,
    leading=43_200,
    prediction=64_800,
    shift=21_600,
    min_event=43_200,
    smooth=64_800,
    recovery=43_200,
    threshold=45.0,
    low=5.0,
    high=150.0,
)


def series(spark: SparkSession, folder: str) -> DataFrame:
    """caseid, t (whole seconds), event_id, event_type and mbp of the events table."""
    rows = table(spark, folder, "events")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return rows.select(F.col("user_id").alias("caseid"), seconds.alias("t"), "event_id", "event_type", F.col("value").alias("mbp"))


def gridded(spark: SparkSession, folder: str, config: BuildConfig = STAND_IN) -> DataFrame:
    return preprocess.preprocess(series(spark, folder), config, tie="event_id")


def labelled(spark: SparkSession, folder: str, config: BuildConfig = STAND_IN) -> DataFrame:
    return events.label_events(gridded(spark, folder, config), "mbp", config.threshold, config.n)


def segmented(spark: SparkSession, folder: str, config: BuildConfig = STAND_IN, raw: bool = False) -> DataFrame:
    return segments.segments(labelled(spark, folder, config), config, raw=raw)
