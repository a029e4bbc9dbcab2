"""Streaming extension: bucket means of a live series and alerts on low ones. Batch operators need none of this."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def low_windows(stream: DataFrame, threshold: float, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Windows of an entity whose values are all below threshold, from (caseid, ts, value), once the watermark passes.

    Windows are aligned to the epoch, not to an entity's first row, as that is not known to a stream's partial state.
    """
    rows = stream.withWatermark("ts", late).groupBy("caseid", F.window("ts", width))
    found = rows.agg(F.max("value").alias("highest"), F.count("value").alias("n"))
    return found.where(F.col("highest") < threshold).select("caseid", F.col("window.start").alias("begins"), "highest", "n")
