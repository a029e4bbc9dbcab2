"""Cohort selection by predicates and semi / anti joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lacks(column: str, word: str) -> Column:
    """The word isn't in the text, whatever the case; null text gives null, so a filter drops it."""
    return ~F.lower(column).contains(word.lower())


def eligible(cases: DataFrame) -> DataFrame:
    """Adults over 18, longer than an hour, no transplants, elective, blood loss under 400 or unknown."""
    return cases.where(
        (F.col("age") > 18)
        & (F.col("caseend") > 3600)
        & lacks("opname", "transplant")
        & lacks("optype", "transplant")
        & (F.col("emop") == 0)
        & ((F.col("intraop_ebl") < 400) | F.col("intraop_ebl").isNull())
    )


def with_tracks(tracks: DataFrame, cases: DataFrame, needed: str, statics: Sequence[str]) -> DataFrame:
    """caseids that have the needed track, are eligible, and lack none of the statics."""
    has = tracks.where(F.col("tname") == needed).select("caseid")
    return eligible(cases).dropna(how="any", subset=list(statics)).join(has, "caseid", "left_semi").select("caseid").distinct()


def only(df: DataFrame, keys: DataFrame, key: str = "caseid") -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def without(df: DataFrame, keys: DataFrame, key: str = "caseid") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def same_keys(left: DataFrame, right: DataFrame, key: str = "caseid") -> DataFrame:
    """One row: distinct keys on the left, on the right, and in both."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").agg(
        F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both")
    )
