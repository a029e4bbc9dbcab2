"""Expressions over one entity's ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def over(key: str = "caseid", pos: str = "pos") -> WindowSpec:
    return Window.partitionBy(key).orderBy(pos)


def back_over(key: str = "caseid", pos: str = "pos") -> WindowSpec:
    """The rows from the last to the current one, in linear time."""
    return Window.partitionBy(key).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)


def lerp(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear interpolation between (x0, y0) and (x1, y1); y0 if there is no right end, null without a left one."""
    inside = y0 + (y1 - y0) * (x - x0) / F.nullif(x1 - x0, F.lit(0))
    return F.coalesce(inside, y0)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def day_seconds(seconds: Column) -> Column:
    """The seconds of a duration within its day."""
    return F.pmod(seconds, F.lit(86_400))


def event_name(event_no: Column, key: Column) -> Column:
    """Text id of an event, unique over all entities; null outside events."""
    return F.when(event_no.isNotNull(), F.concat_ws("_", event_no, key))


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f %%", 100 * x)


def mean_sd(mean: Column, sd: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f (%.{digits}f)", mean, sd)


def median_iqr(q: Column, digits: int = 1) -> Column:
    """From an array of the 25, 50 and 75 % quantiles."""
    return F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", q[1], q[0], q[2])
