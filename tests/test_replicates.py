"""Replicates as vectors against plain loops over resampled rows."""

from __future__ import annotations

import hashlib
import random
from math import exp, factorial

import pytest

from tidewright.operators import replicates


def copies(key, boot):
    digest = hashlib.md5(f"{key}:{boot // 8}".encode()).hexdigest()
    draw = int(digest[4 * (boot % 8) :][:4], 16)
    total, n = 0.0, 0
    while True:
        total += exp(-1) / factorial(n)
        if draw < round(65536 * total) or n == 8:
            return n
        n += 1


def test_copies():
    keys = [str(k) for k in range(3000)]
    found = replicates.copies(keys, 19)
    assert found.shape == (3000, 19) and abs(found.mean() - 1) < 0.02 and abs(found.var() - 1) < 0.03
    assert found[:50].tolist() == [[copies(k, b) for b in range(19)] for k in keys[:50]]


def plain(made, boot, strategy, value):
    rows = [(y, s, "-" if e is None else e) for k, y, s, e in made if s is not None for _ in range(copies(k, boot))]
    pos, neg = [x for x in rows if x[0]], [x for x in rows if not x[0]]
    if not pos or not neg:
        return None
    events = {x[2] for x in pos}
    roc = ap = pr = r0 = f0 = e0 = 0.0
    p0, points = 1.0, []
    for t in sorted({x[1] for x in rows}, reverse=True):
        tp = [x for x in pos if x[1] >= t]
        fp = sum(x[1] >= t for x in neg)
        p, r, f, e = len(tp) / (len(tp) + fp), len(tp) / len(pos), fp / len(neg), len({x[2] for x in tp}) / len(events)
        roc, ap, pr = roc + (f - f0) * (r + r0) / 2, ap + (r - r0) * p, pr + (e - e0) * (p + p0) / 2
        r0, f0, e0, p0 = r, f, e, p
        cost = {"max_precision": -p if e > 0.02 else None, "targeted_precision": abs(p - value), "targeted_recall": abs(e - value), "fixed_threshold": abs(t - value)}
        if cost[strategy] is not None:
            points.append((cost[strategy], -t, p, e))
    _, t, p, e = min(points)
    prev = len(events) / (len(events) + len(neg))
    if not p:
        return (roc, ap, pr, -t, p, e)
    spec = 1 - e * prev * (1 - p) / p / (1 - prev)
    return (roc, ap, pr, -t, p, e, spec, spec * (1 - prev) / (spec * (1 - prev) + (1 - e) * prev), 2 * p * e / (p + e))


@pytest.mark.parametrize(
    ("strategy", "value", "scores"),
    [("max_precision", 0.0, 25), ("targeted_recall", 0.6, 2), ("targeted_precision", 0.4, 400), ("fixed_threshold", 0.5, 25)],
)
def test_against_loops(spark, monkeypatch, strategy, value, scores):
    """Scores of many rows that lie across ranges, events without a name, rows without a score, small blocks."""
    monkeypatch.setattr(replicates, "AT_ONCE", 37)
    rnd = random.Random(scores)
    made = [(f"k{k}", int(rnd.random() < 0.3), rnd.randrange(scores) / scores, rnd.choice([None, *range(25)])) for k in range(400)]
    made += [("none", 1, None, 3), ("é", 0, 0.0, None)]
    df = spark.createDataFrame(made, "row string, y int, score double, label_id int").repartition(3)
    got = {x["boot_id"]: x for x in replicates.evaluated(df, "row", 11, strategy, value, ranges=7).collect()}
    for boot in range(11):
        want = plain(made, boot, strategy, value)
        found = [got[boot][c] for c in replicates.METRICS]
        assert found[: len(want)] == pytest.approx(want)


def test_one_class_and_no_rows(spark):
    kinds = "row int, y int, score double, label_id int"
    assert replicates.evaluated(spark.createDataFrame([(k, 0, 0.5, None) for k in range(9)], kinds), "row", 5).count() == 0
    assert replicates.evaluated(spark.createDataFrame([], kinds), "row", 5).count() == 0
    few = replicates.evaluated(spark.createDataFrame([(1, 1, 0.5, 1), (2, 0, 0.5, 1)], kinds), "row", 40).collect()
    assert {x["boot_id"] for x in few} == {b for b in range(40) if copies("1", b) and copies("2", b)} and all(x["auroc"] == 0.5 for x in few)
    with pytest.raises(ValueError, match="strategy"):
        replicates.evaluated(spark.createDataFrame([], kinds), "row", strategy="best")
