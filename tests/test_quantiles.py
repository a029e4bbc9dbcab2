"""Exact percentiles by refined histograms against the engine's own, and exponential means against plain loops."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import drift, quantiles, stats
from tidewright.operators.quantiles import percentiles

LEVELS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def values(kind: str, n: int) -> list[float]:
    draw = random.Random(kind)
    return {
        "even": lambda: [draw.random() for _ in range(n)],
        "ties": lambda: [float(draw.choice([1, 1, 1, 2, 7])) for _ in range(n)],
        "one": lambda: [3.5] * n,
        "wild": lambda: [draw.choice([-1, 1]) * 10.0 ** draw.randint(-300, 300) for _ in range(n)],
        "hot": lambda: [0.0 if draw.random() < 0.9 else draw.gauss(0, 1) for _ in range(n)],
        "ends": lambda: [-math.inf, math.inf, *[draw.random() for _ in range(n - 2)]],
    }[kind]()


@pytest.mark.parametrize("limit", [0, 7, 400])
def test_equal_to_the_engines(spark, limit):
    """Groups of many shapes, a null group, nulls, a group of nulls only, in one call; exactly the engine's values."""
    rows = [(k, "x", v) for k in ("even", "ties", "one", "wild", "hot", "ends") for v in values(k, 3000)]
    rows += [(None, None, float(k)) for k in range(500)] + [("even", "x", None)] * 40 + [("none", "y", None)] * 3 + [("single", "y", 4.0)]
    df = spark.createDataFrame(rows, "a string, b string, v double").repartition(5)
    found = percentiles(df, "v", LEVELS, ["a", "b"], {"top": F.max("v")}, limit)
    got = {(x["a"], x["b"]): (x["n"], x["q"], x["top"]) for x in found.collect()}
    plain = df.groupBy("a", "b").agg(F.count("v"), F.percentile("v", F.array(*[F.lit(p) for p in LEVELS])), F.max("v"))
    want = {(x[0], x[1]): (x[2], x[3], x[4]) for x in plain.collect()}
    assert got.keys() == want.keys()
    for key, (n, q, top) in want.items():
        assert (got[key][0], got[key][2]) == (n, top)
        assert q == got[key][1] or np.array_equal(np.array(q), np.array(got[key][1]), equal_nan=True), key


def test_no_buffer_of_all_values_beyond_the_limit(spark):
    """Beyond the limit nothing in the plan holds all values of a group: no percentile() and no window over a whole group."""
    df = spark.range(5000).select((F.col("id") % 977).cast("double").alias("v"))
    plan = percentiles(df, "v", [0.5], limit=50)._jdf.queryExecution().toString()
    assert not re.search(r"\bpercentile\(", plan)
    assert re.search(r"\bpercentile\(", percentiles(df, "v", [0.5])._jdf.queryExecution().toString())
    assert percentiles(df, "v", [0.5], limit=50).first()["q"] == df.agg(F.percentile("v", F.array(F.lit(0.5)))).first()[0]


def test_empty_and_null_only(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert percentiles(df, "v", [0.5], limit=0).collect() == [(0, None)]
    assert percentiles(df, "v", [0.5], ["g"], limit=0).count() == 0


def test_statistics_beyond_the_limit(spark, monkeypatch):
    """describe, summaries, duration_quantiles and exceedance give the same beyond the limit as within it."""
    draw = random.Random(4)
    rows = [(k % 3, k, draw.gauss(0, 5), float(draw.randint(0, 9))) for k in range(2000)] + [(1, 1, None, None)]
    df = spark.createDataFrame(rows, "g int, caseid int, a double, b double")

    def all_four() -> list:
        return [
            sorted(map(str, stats.describe(df, ["a", "b"], ["g"]).collect())),
            sorted(map(str, stats.summaries(df, "a", ["g"]).collect())),
            stats.duration_quantiles(df, "caseid", "a").collect(),
            sorted(map(str, drift.exceedance(df.where("g = 0"), df.where("g > 0"), [50, 90, 99], "a").collect())),
        ]

    within = all_four()
    monkeypatch.setattr(quantiles.percentiles, "__defaults__", (*quantiles.percentiles.__defaults__[:-1], 60))
    assert all_four() == within


def plain_ewm(rows: list[tuple[float, float | None]], half_life: float, last: int | None) -> list[tuple[float | None, float | None]]:
    out: list[tuple[float | None, float | None]] = []
    for k in range(len(rows)):
        frame = [(p, v) for p, v in rows[0 if last is None else max(0, k - last + 1) : k + 1] if v is not None]
        if not frame:
            out.append((None, None))
            continue
        w = np.array([0.5 ** ((frame[-1][0] - p) / half_life) for p, _ in frame])
        v = np.array([v for _, v in frame])
        mean = float((w * v).sum() / w.sum())
        rest = w.sum() ** 2 - (w * w).sum()
        var = float((w * (v - mean) ** 2).sum() / w.sum())
        out.append((mean, math.sqrt(var * w.sum() ** 2 / rest) if rest > 0 else None))
    return out


@pytest.mark.parametrize("last", [1, 2, 5, 16, 64, None])
@pytest.mark.parametrize("half_life", [0.01, 0.5, 4.0, 300.0])
def test_exponential_means(spark, last, half_life):
    """Frames over block and span edges, runs of nulls longer than a frame, wide gaps and a first row far from 0."""
    draw = random.Random(9)
    cases = {}
    for case in range(4):
        at, rows = draw.choice([0, 5000]), []
        for k in range(150):
            at += draw.choice([1, 1, 1, 3]) if k != 70 else 3000
            null = draw.random() < (0.3 if case else 0.0) or (case == 2 and 20 <= k < 60) or (case == 3 and k < 90)
            rows.append((at, None if null else draw.gauss(80, 15)))
        cases[case] = rows
    df = spark.createDataFrame([(c, p, v) for c, rows in cases.items() for p, v in rows], "caseid int, pos int, x double").repartition(3)
    found = stats.ewm(df, "x", half_life, last)
    assert found.columns == ["caseid", "pos", "x", "x_ewm_mean", "x_ewm_std"]
    got = {(x["caseid"], x["pos"]): (x["x_ewm_mean"], x["x_ewm_std"]) for x in found.collect()}
    for case, rows in cases.items():
        for (at, _), (mean, sd) in zip(rows, plain_ewm(rows, half_life, last), strict=True):
            mine = got[case, at]
            assert (mine[0] is None) == (mean is None) and (mean is None or math.isclose(mine[0], mean, rel_tol=1e-9)), (case, at)
            assert sd is None or sd < 1e-3 or mine[1] is None or math.isclose(mine[1], sd, rel_tol=1e-5), (case, at)
