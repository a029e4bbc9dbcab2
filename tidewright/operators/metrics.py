"""Event-level precision and recall, curves, thresholds and calibration of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import lerp, safe_ratio

#: Running totals are taken within so many ranges of the scores, then over the ranges.
RANGES = 4096


def _ranged(df: DataFrame, order: str, by: Sequence[str]) -> DataFrame:
    """df with _range, 0 to RANGES - 1: equal widths between a group's least and largest order value."""
    bounds = df.groupBy(*by).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    cut = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))  # one row a group
    width = F.nullif((F.col("_hi") - F.col("_lo")).cast("double"), F.lit(0.0))
    at = F.coalesce(F.floor((F.col(order) - F.col("_lo")) / width * (RANGES - 1)), F.lit(0)).cast("int")
    return cut.withColumn("_range", at).drop("_lo", "_hi")


def running_totals(df: DataFrame, order: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """cum_{value}: totals over the rows of ``by`` with an order value that is no smaller.

    The rows of a group are cut into ranges, summed by range, and only then ordered within a range; no task orders a
    whole group unless its values fall into one range.
    """
    by = list(by)
    cut = _ranged(df, order, by)
    sums = cut.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    above = Window.partitionBy(*by).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_range", *[F.coalesce(F.sum(f"_s_{v}").over(above), F.lit(0)).alias(f"_above_{v}") for v in values])
    inside = Window.partitionBy(*by, "_range").orderBy(F.col(order).desc())
    joined = cut.join(sums, [*by, "_range"])
    totals = {f"cum_{v}": F.col(f"_above_{v}") + F.sum(v).over(inside) for v in values}
    return joined.withColumns(totals).drop("_range", *[f"_above_{v}" for v in values])


def with_next_higher(df: DataFrame, order: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """above_{value}: the value in the row of the next higher order value (distinct in a group); null in the highest row.

    Rows look within their range; a range's highest row takes the lowest of the next range that has any, so what is
    ordered over a whole group is one row a range.
    """
    by = list(by)
    cut = _ranged(df, order, by)
    lowest = cut.groupBy(*by, "_range").agg(F.min_by(F.struct(*values), order).alias("_low"))
    down = Window.partitionBy(*by).orderBy(F.col("_range").desc())
    lowest = lowest.select(*by, "_range", F.lag("_low").over(down).alias("_before"))
    inside = Window.partitionBy(*by, "_range").orderBy(F.col(order).desc())
    first = F.row_number().over(inside) == 1
    found = {f"above_{v}": F.when(first, F.col(f"_before.{v}")).otherwise(F.lag(v).over(inside)) for v in values}
    return cut.join(lowest, [*by, "_range"]).withColumns(found).drop("_range", "_before")


def by_score(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: tp and fp rows, and the events whose best positive row has that score.

    rows has y (0 or 1), score and label_id (of positive rows); null scores are left out.
    """
    rows = rows.where(F.col("score").isNotNull())
    counts = rows.groupBy(*by, "score").agg(F.sum("y").cast("long").alias("tp"), F.sum(1 - F.col("y")).cast("long").alias("fp"))
    firsts = rows.where("y = 1").groupBy(*by, "label_id").agg(F.max("score").alias("score")).groupBy(*by, "score").agg(F.count("*").alias("hits"))
    return counts.join(firsts, [*by, "score"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


def curve(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score (a threshold): precision, recall of rows, recall of events, tpr and fpr. Exact, no sampling.

    above_{ratio} is the ratio at the next higher threshold, which the totals less the score's own counts give.
    """
    return curve_of(by_score(rows, by), by)


def curve_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """curve() of the rows that by_score() has counted; counts is read several times."""
    table = running_totals(counts, "score", ["tp", "fp", "hits"], by)
    totals = table.groupBy(*by).agg(F.max("cum_tp").alias("n_pos"), F.max("cum_fp").alias("n_neg"), F.max("cum_hits").alias("n_events"))
    table = table.join(totals, list(by)) if by else table.crossJoin(F.broadcast(totals))

    def ratios(tp: Column, fp: Column, hits: Column) -> dict[str, Column]:
        return {
            "precision": safe_ratio(tp, tp + fp),
            "recall": safe_ratio(tp, F.col("n_pos")),
            "event_recall": safe_ratio(hits, F.col("n_events")),
            "fpr": safe_ratio(fp, F.col("n_neg")),
        }

    values = ("tp", "fp", "hits")
    here = ratios(*[F.col(f"cum_{c}") for c in values])
    above = ratios(*[F.col(f"cum_{c}") - F.col(c) for c in values])
    return table.select(
        *by, F.col("score").alias("threshold"), *[v.alias(c) for c, v in here.items()],
        "n_pos", "n_neg", "n_events", *[v.alias(f"above_{c}") for c, v in above.items()],
    )


def areas(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """average_precision (steps over rows), auroc and auprc (trapezoids; precision over event recall, from (0, 1)).

    points is all of a curve(): each point has what it needs of the next higher one, so nothing is ordered here.
    """
    before = lambda c, first: F.coalesce(F.col(f"above_{c}"), F.lit(first))
    steps = points.select(
        *by,
        ((F.col("recall") - before("recall", 0.0)) * F.col("precision")).alias("ap"),
        ((F.col("fpr") - before("fpr", 0.0)) * (F.col("recall") + before("recall", 0.0)) / 2).alias("roc"),
        ((F.col("event_recall") - before("event_recall", 0.0)) * (F.col("precision") + before("precision", 1.0)) / 2).alias("pr"),
    )
    return steps.groupBy(*by).agg(F.sum("ap").alias("average_precision"), F.sum("roc").alias("auroc"), F.sum("pr").alias("auprc"))


def pick(points: DataFrame, strategy: str, value: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """The point of a curve by max_precision (event recall over 0.02), targeted_precision, targeted_recall or
    fixed_threshold (the nearest to value). Among equals the highest threshold wins."""
    high_first = -F.col("threshold")
    order: Column
    if strategy == "max_precision":
        points, order = points.where("event_recall > 0.02"), F.struct(-F.col("precision"), high_first)
    elif strategy in ("targeted_precision", "targeted_recall", "fixed_threshold"):
        of = {"targeted_precision": "precision", "targeted_recall": "event_recall", "fixed_threshold": "threshold"}[strategy]
        order = F.struct(F.abs(F.col(of) - value), high_first)
    else:
        raise ValueError(f"no such strategy: {strategy}")
    row = F.struct("threshold", "precision", "event_recall", "n_events", "n_neg")
    return points.groupBy(*by).agg(F.min_by(row, order).alias("_p")).select(*by, "_p.*")


def derived(point: DataFrame) -> DataFrame:
    """prevalence of events, specificity, npv and f1 from a point's precision and event recall."""
    p, r = F.col("precision"), F.col("event_recall")
    prev = safe_ratio(F.col("n_events"), F.col("n_events") + F.col("n_neg"))
    added = point.withColumn("prevalence", prev)
    v = F.col("prevalence")
    false_rate = r * v * (1 - p) / F.nullif(p, F.lit(0.0))
    added = added.withColumn("specificity", 1 - false_rate / F.nullif(1 - v, F.lit(0.0)))
    s = F.col("specificity")
    return added.withColumns(
        {"npv": s * (1 - v) / F.nullif(s * (1 - v) + (1 - r) * v, F.lit(0.0)), "f1": 2 * p * r / F.nullif(p + r, F.lit(0.0))}
    )


def on_grid(points: DataFrame, x: str, y: str, steps: int = 1000, by: Sequence[str] = ()) -> DataFrame:
    """y at ``steps`` even places of x in [0, 1], linear between points; flat outside them.

    Of points with equal x the largest y counts. Each cell from one place to the next keeps its first and last point, so
    what is ordered is a row a place, however many points there are.
    """
    last_step = steps - 1
    knots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("x")).agg(F.max(y).alias("y"))
    place = lambda k: k.cast("double") / last_step
    near = F.least(F.greatest(F.floor(F.col("x") * last_step), F.lit(-1)), F.lit(last_step)).cast("int")
    knots = knots.withColumn("step", near)
    moved = F.when(place(F.col("step")) > F.col("x"), -1).when((F.col("step") < last_step) & (place(F.col("step") + 1) <= F.col("x")), 1).otherwise(0)
    knots = knots.withColumn("step", F.greatest(F.col("step") + moved, F.lit(-1)))
    both = F.struct("x", "y")
    cells = knots.groupBy(*by, "step").agg(F.min_by(both, "x").alias("first"), F.max_by(both, "x").alias("last"))
    keys = knots.select(*by).distinct() if by else points.sparkSession.range(1).select()
    grid = keys.withColumn("step", F.explode(F.sequence(F.lit(-1), F.lit(last_step))))
    cells = grid.join(cells, [*by, "step"], "left")
    order = Window.partitionBy(*by).orderBy("step")  # a row a place
    before = F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    found = cells.select(*by, "step", place(F.col("step")).alias("x"), before.alias("_b"), after.alias("_r"), "first").where("step >= 0")
    found = found.withColumn("_l", F.when(F.col("first.x") == F.col("x"), F.col("first")).otherwise(F.col("_b")))
    value = lerp(F.col("x"), F.col("_l.x"), F.col("_l.y"), F.col("_r.x"), F.col("_r.y"))
    return found.select(*by, "step", "x", F.coalesce(value, F.col("_r.y"), F.col("_l.y")).alias("y"))


def thresholds(*curves: DataFrame) -> DataFrame:
    """The thresholds that any of the curves has, each once."""
    first, *others = [x.select("threshold") for x in curves]
    for other in others:
        first = first.union(other)
    return first.distinct()


def ece(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Expected calibration error: confidence |p - 0.5| + 0.5 in equal right-closed bins of (0, 1]."""
    conf = F.abs(F.col("score") - 0.5) + 0.5
    right = ((F.col("score") > 0.5).cast("int") == F.col("y")).cast("int")
    table = rows.where("score is not null").select(conf.alias("c"), right.alias("ok")).withColumn("bin", F.ceil(F.col("c") * bins))
    table = table.groupBy("bin").agg(F.avg("c").alias("c"), F.avg("ok").alias("ok"), F.count("*").alias("n"))
    return table.agg((F.sum(F.abs(F.col("c") - F.col("ok")) * F.col("n")) / F.sum("n")).alias("ece"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and share of positives in equal right-closed bins of [0, 1]; empty bins are left out."""
    at = F.greatest(F.ceil(F.col("score") * bins), F.lit(1)).cast("int").alias("bin")
    return rows.where("score is not null").groupBy(at).agg(
        F.avg("score").alias("mean_score"), F.avg("y").alias("positive_share"), F.count("*").alias("n")
    )


def nearest(points: DataFrame, at: str, rows: DataFrame, score: str, value: str, key: str) -> DataFrame:
    """points with nearest_{value}: the value of the row whose score is nearest to ``at``; of equally near rows the least key.

    Rows and the distinct values of ``at`` are cut in ranges together. Within a range each value sees the rows before and
    after it; the ends of the ranges are carried across those without rows, so what is ordered over all is a row a range.
    Null stays null, rows without a score are left out, and without any rows all is null.
    """
    known = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_x"))
    known = known.agg(F.min_by(F.struct(F.col(key).alias("key"), F.col(value).alias("value")), key).alias("_row"))
    asked = points.where(F.col(at).isNotNull()).select(F.col(at).cast("double").alias("_x")).distinct()
    both = known.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    cut = _ranged(both, "_x", [])
    own = F.when(~F.col("_asked"), F.struct("_x", "_row"))
    ends = cut.groupBy("_range").agg(F.min_by(own, F.when(~F.col("_asked"), F.col("_x"))).alias("low"), F.max_by(own, F.when(~F.col("_asked"), F.col("_x"))).alias("high"))
    order = Window.orderBy("_range")  # a row a range
    below = F.last("high", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_below")
    above = F.first("low", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_above")
    inside = Window.partitionBy("_range").orderBy("_x")
    before = F.last(own, True).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(own, True).over(inside.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    seen = cut.withColumns({"_before": before, "_after": after}).where("_asked").join(ends.select("_range", below, above), "_range")
    sides = [F.coalesce("_before", "_below"), F.coalesce("_after", "_above")]
    near = F.least(*[F.when(s.isNotNull(), F.struct(F.abs(F.col("_x") - s["_x"]).alias("far"), s["_row"]["key"].alias("key"), s["_row"]["value"].alias("value"))) for s in sides])
    found = seen.select("_x", near["value"].alias(f"nearest_{value}"))
    return points.join(found, F.col(at).cast("double") == F.col("_x"), "left").drop("_x")


def thinned(points: DataFrame, size: int = 1000, seed: int = 0) -> DataFrame:
    """At most ``size`` points of a curve and its two ends, drawn without replacement; curves of no more points stay whole.

    A point is drawn with a weight of the change of precision from the next higher threshold, by the smallest of exponential
    keys -ln(u) / weight, where u comes from a hash of seed and threshold. above_{ratio} are those of the next higher
    point that is kept, so areas() of the result are those of the coarser curve. Curves are exact where this isn't used.
    """
    number = F.round(F.col("threshold") * 1e9).cast("long").cast("string")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), number)), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    weight = F.abs(F.col("precision") - F.col("above_precision"))
    keyed = points.withColumn("_key", F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf"))))
    drawn = keyed.orderBy("_key", F.desc("threshold")).limit(size)
    ends = keyed.agg(F.min("threshold").alias("low"), F.max("threshold").alias("high"), F.count("*").alias("n")).first()
    if ends["n"] <= size:
        return points
    last = keyed.where(F.col("threshold").isin(ends["low"], ends["high"]))
    names = ("precision", "recall", "event_recall", "fpr")
    kept = drawn.union(last).dropDuplicates(["threshold"]).drop("_key", *[f"above_{c}" for c in names])
    return with_next_higher(kept, "threshold", names).select(*points.columns)
