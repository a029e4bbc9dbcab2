"""Calibration by folds against a plain loop, the nearest row, thinned curves, and evaluation over replicates."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import metrics, ml, replicates


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(6)
    rows = []
    for k in range(300):
        x = rnd.gauss(70, 12)
        rows.append((k, x, int(rnd.random() < 1 / (1 + np.exp((x - 62) / 5)))))
    return spark.createDataFrame([*rows, (999, None, 1)], "row long, last_map_value double, label int")


def platt(margin, y):
    """Newton steps on the smoothed log loss."""
    n1, n0 = y.sum(), (1 - y).sum()
    to = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-12 * np.eye(2), x.T @ (to - p))
    return w


def test_calibration_by_folds(spark, made, tmp_path):
    models = ml.calibrated_by_folds(made, "row", folds=3)
    assert len(models) == 3
    rows = made.withColumn("fold", F.pmod(F.xxhash64("row"), F.lit(3))).dropna()
    total = 0.0
    for fold, model in enumerate(models):
        found = model.transform(rows).select("row", "fold", "label", F.col("margin"), F.col("probability")).orderBy("row").collect()
        margin, y = np.array([x["margin"][0] for x in found]), np.array([x["label"] for x in found])
        own = np.array([x["fold"] == fold for x in found])
        a, b = platt(margin[own], y[own])
        want = 1 / (1 + np.exp(-(a * margin + b)))
        assert [x["probability"][1] for x in found] == pytest.approx(want, abs=1e-4)
        total = total + want
    ml.save_ensemble(models, str(tmp_path / "e"))
    again = ml.load_ensemble(spark, str(tmp_path / "e"))
    scored = ml.ensemble_scored(again, rows.withColumn("score", F.lit("x")).drop("score")).orderBy("row").collect()
    assert [x["score"] for x in scored] == pytest.approx(total / 3, abs=1e-4)
    with pytest.raises(ValueError, match="both classes"):
        ml.calibrated_by_folds(made.where("label = 1"), "row")


def test_nearest_row(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice([rnd.random(), 0.25, 0.5, 1e9, -3.0]), f"v{k}") for k in range(200)] + [(500, None, "none")]
    points = [(k, rnd.choice([rnd.random(), 0.375, 0.5, -1e12, 1e12])) for k in range(100)] + [(900, None), (901, 0.5)]
    df, at = spark.createDataFrame(rows, "k int, s double, v string"), spark.createDataFrame(points, "p int, t double")
    got = {x["p"]: x["nearest_v"] for x in metrics.nearest(at, "t", df, "s", "v", "k").collect()}
    known = [x for x in rows if x[1] is not None]
    assert got == {p: None if t is None else min(known, key=lambda x: (abs(x[1] - t), x[0]))[2] for p, t in points}
    assert {x["nearest_v"] for x in metrics.nearest(at, "t", df.limit(0), "s", "v", "k").collect()} == {None}
    assert metrics.nearest(at.limit(0), "t", df, "s", "v", "k").count() == 0


def test_thinned_curves(spark):
    rnd = random.Random(1)
    rows = [(int(rnd.random() < s / 400), s / 400, k % 40) for k in range(1500) for s in [rnd.randrange(400)]]
    points = metrics.curve(spark.createDataFrame(rows, "y int, score double, label_id int")).cache()
    whole = {x["threshold"]: x for x in points.collect()}
    assert metrics.thinned(points, len(whole)).count() == len(whole)
    drawn = {}
    for seed in range(5):
        kept = sorted(metrics.thinned(points, 60, seed).collect(), key=lambda x: -x["threshold"])
        assert 60 <= len(kept) <= 62 and {max(whole), min(whole)} <= {x["threshold"] for x in kept}
        assert all(x["precision"] == whole[x["threshold"]]["precision"] for x in kept)
        assert [x["above_precision"] for x in kept] == [None, *[x["precision"] for x in kept[:-1]]]
        for x in kept:
            drawn[x["threshold"]] = drawn.get(x["threshold"], 0) + 1
    weight = {t: abs(x["precision"] - x["above_precision"]) for t, x in whole.items() if x["above_precision"] is not None and t != min(whole)}
    order = sorted(weight, key=weight.get)
    shares = [np.mean([drawn.get(t, 0) / 5 for t in part]) for part in np.array_split(order, 4)]
    assert shares[0] < shares[1] < shares[2] < shares[3] and shares[3] > 3 * shares[0]


def test_evaluation_over_replicates(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(300):
        y = int(rnd.random() < 0.3)
        rows.append((k, y, k // 10 if y else None, round(rnd.gauss(y, 1), 2), round(rnd.gauss(2 * y, 1), 2), 80.0 - k % 37))
    df = spark.createDataFrame(rows, "k int, y int, label_id int, one double, two double, value double")
    base, model = df.withColumnRenamed("one", "score"), df.withColumnRenamed("two", "score")
    got = {x["model"]: x for x in ml.replicated_evaluation(base, [model], "k", 15, "value").collect()}
    own = replicates.evaluated(base, "k", 15).collect()
    recall = float(np.median([x["event_recall"] for x in own]))
    other = replicates.evaluated(model, "k", 15, "targeted_recall", recall).collect()
    for name, found in (("baseline", own), ("model 0", other)):
        for c in replicates.METRICS:
            values = [x[c] for x in found]
            assert [got[name][f"{c}_{k}"] for k in ("mean", "sd", "median")] == pytest.approx([np.mean(values), np.std(values), np.median(values)])
    signals = [min(rows, key=lambda r: (abs(r[3] - x["threshold"]), r[0]))[5] for x in own]
    assert got["baseline"]["threshold_value_median"] == np.median(signals) and got["model 0"]["threshold_value_median"] is None
