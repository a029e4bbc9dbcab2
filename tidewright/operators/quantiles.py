"""Exact percentiles of groups of any size, by histograms that are refined around the ranks asked for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged

#: Different values of a group that one buffer may hold (some 40 MB), and rows of a range that are put in order.
LIMIT = 500_000
#: Of the sketches that edges are taken from; their memory follows it, not the rows.
ACCURACY = 10_000


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; b's keys are dropped."""
    renamed = {k: f"_same_{i}" for i, k in enumerate(keys)}
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(c)) for k, c in renamed.items()])
    return a.join(b.withColumnsRenamed(renamed), on, how).drop(*renamed.values())


def _histogram(rows: DataFrame, edges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """rows with _slot, and for each slot its size, its least and greatest value and the rows before it.

    Odd slots are the edges themselves, even ones what lies between two of them, so a value that fills a group is an edge.
    """
    below, is_edge = F.size(F.filter("_edges", lambda e: e < F.col("_v"))), F.array_contains("_edges", F.col("_v"))
    coded = _joined(rows, edges, keys).select(*keys, "_v", (2 * below + is_edge.cast("int")).alias("_slot"))
    counts = coded.groupBy(*keys, "_slot").agg(F.count("*").alias("_size"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return coded, counts.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))


def _ranked(rows: DataFrame, edges: DataFrame, wanted: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """by, _rank and _value for each wanted (by, _path, _rank, _at): the value of which _at values of the path come before.

    Each turn keeps the slots that hold a rank and cuts them by 255 new edges, and every edge leaves at least one value behind.
    """
    keys, found = [*by, "_path"], []
    while True:
        coded, slots = _histogram(rows, edges, keys)
        hits = _joined(wanted, slots, keys).where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_size")))
        hits = staged(hits.withColumn("_at", F.col("_at") - F.col("_before")), "percentile-slots")
        single = F.col("_least") == F.col("_most")
        found.append(hits.where(single).select(*by, "_rank", F.col("_least").alias("_value")))
        left = hits.where(~single)
        size = left.agg(F.max("_size")).first()[0]
        if size is None:
            break
        deeper = F.concat_ws("/", "_path", F.col("_slot").cast("string"))
        rows = _joined(coded, left.select(*keys, "_slot").distinct(), [*keys, "_slot"]).withColumn("_path", deeper).select(*keys, "_v")
        wanted = left.withColumn("_path", deeper).select(*keys, "_rank", "_at")
        if size <= limit:
            ordered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1)
            found.append(_joined(wanted, ordered, [*keys, "_at"]).select(*by, "_rank", F.col("_v").alias("_value")))
            break
        rows = staged(rows, "percentile-rows")
        cuts = F.percentile_approx("_v", [k / 256 for k in range(1, 256)], ACCURACY)
        edges = rows.groupBy(*keys).agg(F.array_distinct(cuts).alias("_edges"))
    return reduce(DataFrame.unionByName, found)


def percentiles(
    df: DataFrame, column: str, levels: Sequence[float], by: Sequence[str] = (), also: Mapping[str, Column] | None = None, limit: int = LIMIT
) -> DataFrame:
    """by, n (values that are not null), q (percentiles at the levels, 0 to 1, interpolated) and the aggregates ``also``.

    Results are those of ``F.percentile``, which holds all different values of a group in one buffer; that is used as long as
    no group has more than some ``limit`` different values (an estimate, 5 %). Beyond it, edges on both sides of each level come from a sketch, rows are counted
    between them, and only ranges that hold a wanted rank go on, to be cut again or, within the limit, put in order.
    A group without values has null percentiles.
    """
    also = dict(also or {})
    value = F.col(column).cast("double")
    different = df.groupBy(*by).agg(F.approx_count_distinct(value).alias("n"))
    extra = [c.alias(name) for name, c in also.items()]
    if (different.agg(F.max("n")).first()[0] or 0) <= limit:
        return df.groupBy(*by).agg(F.count(column).alias("n"), F.percentile(value, F.array(*[F.lit(float(p)) for p in levels])).alias("q"), *extra)
    near = sorted({min(1.0, max(0.0, p + e / ACCURACY)) for p in levels for e in (-2, 2)})
    heads = df.groupBy(*by).agg(F.count(column).alias("n"), F.array_distinct(F.percentile_approx(value, near, ACCURACY)).alias("_edges"), *extra)
    heads = staged(heads.withColumn("_path", F.lit("")), "percentile-groups")
    places = F.transform(F.array(*[F.lit(float(p)) for p in levels]), lambda p: (F.col("n") - 1) * p)
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(F.floor(x), F.ceil(x)))))
    wanted = heads.where("n > 0").select(*by, "_path", F.explode(ranks).alias("_rank")).withColumn("_at", F.col("_rank"))
    rows = df.select(*by, F.lit("").alias("_path"), value.alias("_v")).where(F.col("_v").isNotNull())
    values = _ranked(rows, heads.select(*by, "_path", "_edges"), wanted, by, limit)
    values = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_values"))  # two a level
    out = _joined(heads, values.withColumn("_path", F.lit("")), [*by, "_path"], "left")

    def between(x: Column) -> Column:
        low, high = F.element_at("_values", F.floor(x)), F.element_at("_values", F.ceil(x))
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    return out.select(*by, "n", F.when(F.col("n") > 0, F.transform(places, between)).alias("q"), *also)
