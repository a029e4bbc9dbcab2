"""Sliding observation / lead / prediction segments of labelled series, with their features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BuildConfig
from ..functions.series import back_over, over

#: Frames longer than this use running sums, which cost the same at any length.
LONG_FRAME = 64


def _ahead(column: str | Column, rows: int) -> Column:
    w = over()
    return F.lead(column, rows).over(w) if rows >= 0 else F.lag(column, -rows).over(w)


def _between(running: str, first: int, last: int) -> Column:
    """Sum over the rows from pos + first up to, not including, pos + last, from a running sum."""
    low = F.coalesce(_ahead(running, first - 1), F.lit(0)) if first <= 0 else _ahead(running, first - 1)
    return _ahead(running, last - 1) - low


def windows(df: DataFrame, config: BuildConfig) -> DataFrame:
    """is_start marks the first rows of segments: every shift-th, while more than ``length`` rows follow."""
    size = F.count(F.lit(1)).over(Window.partitionBy("caseid"))
    return df.withColumn("is_start", (F.col("pos") % config.shift_rows == 0) & (F.col("pos") < size - config.length))


def validity(df: DataFrame, config: BuildConfig, main: str = "mbp") -> DataFrame:
    """The four rules of a segment that begins in a row: in_bounds, no_event_before, recovered and enough_data.

    All rows' main values lie in [low, high]; no label in observation and lead; none in the recovery rows before; and
    of each signal (but those that may miss) at most the given share of rows is null.
    """
    to_here = over().rowsBetween(Window.unboundedPreceding, 0)
    checked = [c for c in config.signals if c not in config.may_miss]
    bad = (F.col(main) < config.low) | (F.col(main) > config.high)
    sums = {"_bad": F.sum(F.coalesce(bad, F.lit(False)).cast("int")).over(to_here), "_events": F.sum("label").over(to_here)}
    sums |= {f"_null_{c}": F.sum(F.col(c).isNull().cast("int")).over(to_here) for c in checked}
    full = F.lit(True)
    for c in checked:
        full = full & (_between(f"_null_{c}", 0, config.length) <= config.max_missing * config.length)
    earlier = F.coalesce(_ahead("_events", -1), F.lit(0)) - F.coalesce(_ahead("_events", -config.recovery_rows - 1), F.lit(0))
    rules = {
        "in_bounds": _between("_bad", 0, config.length) == 0,
        "no_event_before": _between("_events", 0, config.obs + config.lead) == 0,
        "recovered": earlier == 0,
        "enough_data": full,
    }
    return df.withColumns(sums).withColumns(rules).drop(*sums)


def outcomes(df: DataFrame, config: BuildConfig) -> DataFrame:
    """seg_label, time_before_event (seconds from the last observation row), seg_event_no and time of a segment.

    The first positive row at or after a row comes from a running minimum in reverse order.
    """
    first = F.min("_positive").over(back_over())
    at = config.obs + config.lead
    positive = F.when(F.col("label") == 1, F.struct("pos", "event_no"))
    found = df.withColumn("_positive", positive).withColumn("_next", first).withColumn("_hit", _ahead("_next", at))
    inside = F.coalesce(F.col("_hit.pos") < F.col("pos") + config.length, F.lit(False))
    return found.withColumns(
        {
            "seg_label": inside.cast("int"),
            "time_before_event": F.when(inside, (F.col("_hit.pos") - F.col("pos") - config.obs + 1) * config.step),
            "seg_event_no": F.when(inside, F.col("_hit.event_no")),
            "time": _ahead("t", config.obs - 1),
        }
    ).drop("_positive", "_next", "_hit")


def _regression(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, syy: Column, at: Column, rows: int) -> dict[str, Column]:
    vx, vxy, vy = sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n
    slope = vxy / vx
    return {
        "constant": sy / n + slope * (at - sx / n),
        "slope": slope,
        "std": F.sqrt(F.greatest(F.lit(0.0), vy - vxy * vxy / vx) / (rows - 1)),
    }


def trends(df: DataFrame, config: BuildConfig, halves: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """{signal}_{constant,slope,std}_{seconds} of the segment that begins in a row, by least squares.

    The last h observation rows are fitted against -h..-1: the value at 0, the slope a row, and the residuals'
    deviation (n - 1). Short frames use the engine's regressions, long ones running sums of the values less the
    entity's mean, so the cost does not follow the frame. ``halves`` (seconds, rows) are those of the config unless given.
    """
    halves = list(zip(config.half_times, config.half_rows, strict=True)) if halves is None else list(halves)
    out: dict[str, Column] = {}
    w, to_here = over(), over().rowsBetween(Window.unboundedPreceding, 0)
    long_ = [s for s in config.signals if max((rows for _, rows in halves), default=0) > LONG_FRAME]
    if long_:
        df = df.withColumns({f"_c_{s}": F.col(s) - F.avg(s).over(Window.partitionBy("caseid")) for s in long_})
        sums = {}
        for s in long_:
            c, x = F.col(f"_c_{s}"), F.col("pos").cast("double")
            sums |= {f"_y_{s}": F.sum(c).over(to_here), f"_xy_{s}": F.sum(c * x).over(to_here), f"_yy_{s}": F.sum(c * c).over(to_here)}
        df = df.withColumns(sums)
    for seconds, rows in halves:
        a, b = config.obs - rows, config.obs
        for s in config.signals:
            if rows <= LONG_FRAME:
                frame = w.rowsBetween(a, b - 1)
                x = F.col("pos").cast("double")
                slope = F.regr_slope(F.col(s), x).over(frame)
                vy, vxy, vx = (f(F.col(s), x).over(frame) for f in (F.regr_syy, F.regr_sxy, F.regr_sxx))
                parts = {
                    "constant": F.regr_intercept(F.col(s), x).over(frame) + slope * (F.col("pos") + config.obs),
                    "slope": slope,
                    "std": F.sqrt(F.greatest(F.lit(0.0), vy - vxy * vxy / F.nullif(vx, F.lit(0.0))) / (rows - 1)),
                }
            else:
                n = F.lit(float(rows))
                first = F.col("pos") + a
                sx = n * first + n * (n - 1) / 2
                sxx = n * first * first + first * n * (n - 1) + (n - 1) * n * (2 * n - 1) / 6
                sy, sxy, syy = (_between(f"_{k}_{s}", a, b) for k in ("y", "xy", "yy"))
                parts = _regression(n, sx, sy, sxx, sxy, syy, F.col("pos") + config.obs, rows)
                mean = F.col(s) - F.col(f"_c_{s}")
                parts["constant"] = parts["constant"] + mean
            out |= {f"{s}_{kind}_{seconds}": value for kind, value in parts.items()}
    return df.withColumns(out).drop(*[c for s in long_ for c in (f"_c_{s}", f"_y_{s}", f"_xy_{s}", f"_yy_{s}")])


def chunks(df: DataFrame, config: BuildConfig, keep: Column, names: Sequence[str], size: int) -> DataFrame:
    """caseid, _chunk, _rows (a chunk's rows and what an observation may reach beyond it, by pos) and _starts (its kept rows)."""
    others = [c for c in df.columns if c not in ("caseid", *names)]
    own = F.floor(F.col("pos") / size)
    reached = (F.col("pos") - own * size < config.obs - 1) & (own > 0)
    rows = df.withColumn("_keep", keep).withColumn("_own", own).withColumn("_chunk", F.explode(F.when(reached, F.array(own - 1, own)).otherwise(F.array(own))))
    return rows.groupBy("caseid", "_chunk").agg(
        F.sort_array(F.collect_list(F.struct("pos", *[F.col(s).alias(f"_{s}") for s in names]))).alias("_rows"),
        F.collect_list(F.when(F.col("_keep") & (F.col("_own") == F.col("_chunk")), F.struct(*others))).alias("_starts"),
    )


def flattened(df: DataFrame, config: BuildConfig, keep: Column, signals: Sequence[str] | None = None, chunk: int = 4096) -> DataFrame:
    """The rows of df that ``keep``, with {signal}_{k}: the k-th observation value of the segment that begins in a row.

    Values are gathered by chunks of ``chunk`` rows (at least an observation), in order of pos (from 0, without gaps), so no
    row holds an entity however long it is; only the kept rows read from their chunk. Columns of the signals themselves are
    left out.
    """
    names = list(signals or config.signals)
    size = max(chunk, config.obs)
    series = chunks(df, config, keep, names, size)
    starts = series.select("caseid", "_chunk", "_rows", F.explode("_starts").alias("_start"))
    at = (F.col("_start.pos") - F.col("_chunk") * size).cast("int")
    values = [F.get("_rows", at + k)[f"_{s}"].alias(f"{s}_{k}") for s in names for k in range(config.obs)]
    return starts.select("caseid", "_start.*", *values)


def trends_at(df: DataFrame, config: BuildConfig, keep: Column, chunk: int = 4096) -> DataFrame:
    """The rows of df that ``keep``, with the columns of trends(); other rows cost no regression.

    Frames of up to LONG_FRAME rows are read from their chunk (see flattened) at the kept rows only, against x = -rows..-1
    and values less the last observed one. Longer ones are running sums, in all rows. Columns of the signals are left out.
    """
    halves = list(zip(config.half_times, config.half_rows, strict=True))
    short = [x for x in halves if x[1] <= LONG_FRAME]
    if len(short) < len(halves):
        df = trends(df, config, [x for x in halves if x[1] > LONG_FRAME])
    names, size = list(config.signals), max(chunk, config.obs)
    series = chunks(df, config, keep, names, size).where(F.size("_starts") > 0)
    at = lambda start: (start["pos"] - F.col("_chunk") * size).cast("int")
    none = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "xy", "yy")])

    def sums(start: Column, signal: str, rows: int) -> Column:
        def add(all_: Column, row: Column) -> Column:
            x, y = (row["pos"] - start["pos"] - config.obs).cast("double"), row[f"_{signal}"] - level(start, signal)
            more = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
            return F.when(y.isNull(), all_).otherwise(F.struct(*[(all_[k] + v).alias(k) for k, v in more.items()]))

        return F.aggregate(F.slice("_rows", at(start) + (config.obs - rows + 1), F.lit(rows)), none, add)

    def level(start: Column, signal: str) -> Column:
        return F.coalesce(F.get("_rows", at(start) + (config.obs - 1))[f"_{signal}"], F.lit(0)).cast("double")

    def read(start: Column) -> Column:
        parts = [sums(start, s, rows).alias(f"_{s}_{seconds}") for seconds, rows in short for s in names]
        return F.struct(start.alias("_start"), *[level(start, s).alias(f"_{s}") for s in names], *parts)

    found = series.select("caseid", F.explode(F.transform("_starts", read)).alias("_s"))
    out = {}
    for seconds, rows in short:
        for s in names:
            n, x, y, xx, xy, yy = (F.col(f"_s._{s}_{seconds}.{k}") for k in ("n", "x", "y", "xx", "xy", "yy"))
            n = F.nullif(n, F.lit(0.0))
            vx, vxy, vy = F.nullif(xx - x * x / n, F.lit(0.0)), xy - x * y / n, yy - y * y / n
            slope = vxy / vx
            out[f"{s}_constant_{seconds}"] = y / n - slope * (x / n) + F.col(f"_s._{s}")
            out[f"{s}_slope_{seconds}"] = slope
            out[f"{s}_std_{seconds}"] = F.sqrt(F.greatest(F.lit(0.0), vy - vxy * vxy / vx) / (rows - 1))
    return found.select("caseid", "_s._start.*", *[v.alias(k) for k, v in out.items()])


def segments(df: DataFrame, config: BuildConfig, main: str = "mbp", raw: bool = False) -> DataFrame:
    """One row per valid segment of a labelled grid (caseid, pos, t, signals, label, event_no).

    All steps order the same entities by pos, so one exchange serves them.
    """
    rows = windows(outcomes(validity(df, config, main), config), config)
    valid = F.expr("is_start and in_bounds and no_event_before and recovered and enough_data")
    if raw:
        rows = flattened(rows, config, valid)
    else:
        rows = trends_at(rows.withColumn("last_map_value", _ahead(main, config.obs - 1)), config, valid)
    own = [f"{s}_{k}" for s in config.signals for k in range(config.obs)] if raw else [*config.feature_names(), "last_map_value"]
    return rows.select(
        "caseid", *own, F.col("seg_label").alias("label"), "time", "time_before_event", F.col("seg_event_no").alias("event_no")
    )


def lead_time_filter(df: DataFrame, seconds: int, column: str = "time_before_event") -> DataFrame:
    """Segments whose event is at least so far ahead, and all without one."""
    return df.where(F.col(column).isNull() | (F.col(column) >= seconds))
