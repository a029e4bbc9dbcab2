from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import bootstrap, drift, metrics, ml


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(2)
    made = [(k, int(rnd.random() < 0.3), rnd.randrange(60) / 60, rnd.randrange(25)) for k in range(400)]
    return made, spark.createDataFrame(made, "event_id int, y int, score double, label_id int")


def plain_curve(made):
    events = {x[3] for x in made if x[1]}
    n_pos, n_neg = sum(x[1] for x in made), sum(1 - x[1] for x in made)
    out = {}
    for t in {x[2] for x in made}:
        hit = [x for x in made if x[2] >= t]
        tp = sum(x[1] for x in hit)
        out[t] = (tp / len(hit), tp / n_pos, len({x[3] for x in hit if x[1]}) / len(events), (len(hit) - tp) / n_neg)
    return out


def test_curve_and_areas(rows):
    made, df = rows
    points = metrics.curve(df)
    got = {x["threshold"]: (x["precision"], x["recall"], x["event_recall"], x["fpr"]) for x in points.collect()}
    want = plain_curve(made)
    assert got == pytest.approx(want) if not isinstance(next(iter(want.values())), tuple) else all(got[t] == pytest.approx(want[t]) for t in want)
    found = metrics.areas(points).first()
    ap = auc = pr = 0.0
    r0 = f0 = e0 = 0.0
    p0 = 1.0
    for t in sorted(want, reverse=True):
        p, r, e, f = want[t]
        ap, auc, pr = ap + (r - r0) * p, auc + (f - f0) * (r + r0) / 2, pr + (e - e0) * (p + p0) / 2
        r0, f0, e0, p0 = r, f, e, p
    assert [found["average_precision"], found["auroc"], found["auprc"]] == pytest.approx([ap, auc, pr])


def test_one_score_only(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (0, 0.5, 2)], "y int, score double, label_id int")
    assert metrics.areas(metrics.curve(df)).first()["auroc"] == pytest.approx(0.5)
    assert metrics.pick(metrics.curve(df), "max_precision").first()["precision"] == 0.5


def test_empty_scores(spark):
    df = spark.createDataFrame([], "y int, score double, label_id int")
    assert metrics.curve(df).count() == 0


def test_grid_is_linear(spark):
    df = spark.createDataFrame([(0.25, 0.0), (0.75, 1.0)], "x double, y double")
    got = [x["y"] for x in metrics.on_grid(df, "x", "y", 5).orderBy("step").collect()]
    assert got == pytest.approx([0.0, 0.0, 0.5, 1.0, 1.0])


def test_poisson_copies_have_mean_one(spark):
    df = spark.range(2000).select("id")
    n = bootstrap.poisson(df, 10, "id").count()
    assert abs(n / 20_000 - 1) < 0.05


def test_confidence_of_equal_distances(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "distance double")
    assert {x["confidence"] for x in drift.confidence(df, 2.0).collect()} == {100.0}


def test_next_higher_and_grid_against_loops(spark):
    rnd = np.random.default_rng(5)
    rows = [(g, float(t), float(rnd.random())) for g in (1, 2) for t in np.unique(np.concatenate([rnd.random(300), rnd.random(40) / 1e6, [0.0, 0.25, 1.0, 2.5]]))]
    df = spark.createDataFrame(rows, "g int, t double, v double")
    got = {(x["g"], x["t"]): x["above_v"] for x in metrics.with_next_higher(df, "t", ["v"], ["g"]).collect()}
    places = {(x["g"], x["step"]): x["y"] for x in metrics.on_grid(df, "t", "v", 41, ["g"]).collect()}
    for g in (1, 2):
        own = sorted((t, v) for h, t, v in rows if h == g)
        for k, (t, _) in enumerate(own):
            assert got[g, t] == (own[k + 1][1] if k + 1 < len(own) else None)
        want = np.interp(np.arange(41) / 40, [t for t, _ in own], [v for _, v in own])
        assert [places[g, k] for k in range(41)] == pytest.approx(want.tolist())


def test_models_are_saved_and_evaluated(spark, tmp_path):
    rnd = np.random.default_rng(3)
    rows = [(float(x), int(x + rnd.normal() > 1), f"{k}") for k, x in enumerate(rnd.normal(size=300))]
    df = spark.createDataFrame(rows, "last_map_value double, label int, label_id string")
    model = ml.baseline(df)
    ml.save(model, str(tmp_path / "model"))
    ml.save(model, str(tmp_path / "model"))
    scores = [ml.scored(m, df).select(F.col("label").alias("y"), "score", "label_id") for m in (model, ml.load(str(tmp_path / "model")))]
    assert sorted(map(str, scores[0].collect())) == sorted(map(str, scores[1].collect()))
    base, other = ml.evaluation(*scores).collect()
    assert (base["model"], other["model"]) == ("baseline", "model")
    assert base["auroc"] == pytest.approx(other["auroc"]) and base["auroc"] > 0.7
    assert base["event_recall"] == pytest.approx(other["event_recall"])


def test_exceedance_by_buckets(spark):
    """Ties with a limit, equal limits, levels out of order, nulls and empty tables."""
    values = [1.0, 2.0, 2.0, 2.0, 2.0, 9.0, 4.0, 3.0]
    others = [0.0, 1.0, 2.0, 2.0, 2.5, 4.0, 9.0, 50.0, None]
    left, right = (spark.createDataFrame([(v,) for v in x], "distance double") for x in (values, others))
    got = {x["level"]: (x["limit"], x["share_above"]) for x in drift.exceedance(left, right, [90, 10, 50, 30]).collect()}
    limits = {q: float(np.percentile(values, q)) for q in (10, 30, 50, 90)}
    assert {q: x[0] for q, x in got.items()} == pytest.approx(limits)
    assert {q: x[1] for q, x in got.items()} == pytest.approx({q: sum(v > limit for v in others[:-1]) / 8 for q, limit in limits.items()})
    assert drift.exceedance(left, right.limit(0), [50]).count() == drift.exceedance(left.limit(0), right, [50]).count() == 0


def test_first_by_hash(spark):
    """The same rows as ranking each whole group, with ties larger than the sample."""
    from pyspark.sql import Window

    from tidewright.operators import stats

    rnd = random.Random(5)
    rows = [(g, float(rnd.choice([rnd.randrange(9), rnd.randrange(100_000)]))) for g in "abc" for _ in range(2000)] + [("d", 1.0)] * 500 + [("e", 2.0)] * 3
    values = spark.createDataFrame(rows, "g string, v double")
    for sample in (1, 200, 1500):
        ranked = values.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("v"), "v"))).where(F.col("k") <= sample)
        want = sorted((x["g"], x["v"]) for x in ranked.collect())
        assert sorted((x["g"], x["v"]) for x in stats.first_by_hash(values, "g", sample).collect()) == want
