"""Sustained low-value events: labels, ids and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import event_name, over


def low_runs(df: DataFrame, column: str, threshold: float, rows: int, out: str = "low_run") -> DataFrame:
    """1 where all values of the last ``rows`` rows (fewer at the start) are below threshold; nulls are passed over."""
    most = F.max(column).over(over().rowsBetween(-(rows - 1), 0))
    return df.withColumn(out, F.coalesce(most < threshold, F.lit(False)).cast("int"))


def dilate(df: DataFrame, rows: int, low_run: str = "low_run", out: str = "label") -> DataFrame:
    """1 where a low run ends within the next ``rows`` rows; 0 in an entity's last rows - 1 rows."""
    ahead = F.max(low_run).over(over().rowsBetween(0, rows - 1))
    size = F.count(F.lit(1)).over(Window.partitionBy("caseid"))
    return df.withColumn(out, F.when(F.col("pos") <= size - rows, ahead).otherwise(0))


def event_ids(df: DataFrame, label: str = "label") -> DataFrame:
    """event_no counts the changes from 0 to 1 (an event in the first row has 0), null outside; label_id is its name."""
    begins = F.when((F.col(label) == 1) & (F.lag(label).over(over()) == 0), 1).otherwise(0)
    number = F.sum("_begins").over(over().rowsBetween(Window.unboundedPreceding, 0))
    numbered = df.withColumn("_begins", begins).withColumn("event_no", F.when(F.col(label) == 1, number).cast("int"))
    return numbered.withColumn("label_id", event_name(F.col("event_no"), F.col("caseid"))).drop("_begins")


def label_events(df: DataFrame, column: str, threshold: float, rows: int) -> DataFrame:
    """label, event_no and label_id of each row of a series (caseid, pos, column)."""
    return event_ids(dilate(low_runs(df, column, threshold, rows), rows)).drop("low_run")


def event_summary(df: DataFrame, column: str) -> DataFrame:
    """Begin, end, rows and lowest value of each event."""
    return df.where("label = 1").groupBy("caseid", "event_no").agg(
        F.min("t").alias("begins"), F.max("t").alias("ends"), F.count("*").alias("n_rows"), F.min(column).alias("lowest")
    )
