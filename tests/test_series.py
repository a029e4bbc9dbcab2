"""Behaviours of labelling, validation, resampling and features against plain loops."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.config import BuildConfig
from tidewright.operators import cohort, events, preprocess, resample, segments, splits, stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_sustained_events(spark):
    """Two events, one over a gap; a run of missing values is none; ids count from 1 and are null outside."""
    values: list[float | None] = [100.0] * 200
    values[35:76] = [64.0] * 41
    values[110:140] = [55.0] * 30
    values[120:125] = [None] * 5
    values[150:180] = [None] * 30
    df = frame(spark, [(1, k, float(k), v) for k, v in enumerate(values)], "caseid int, pos int, t double, mbp double")
    found = events.label_events(df, "mbp", 65.0, 30).orderBy("pos").collect()
    assert [k for k, x in enumerate(found) if x["label"]] == [*range(35, 76), *range(110, 140)]
    assert {x["event_no"] for x in found[35:76]} == {1} and {x["label_id"] for x in found[110:140]} == {"2_1"}
    assert found[0]["event_no"] is None and found[160]["label_id"] is None


def test_event_in_first_row_has_number_zero(spark):
    df = frame(spark, [(1, k, float(k), 50.0 if k < 3 else 100.0) for k in range(9)], "caseid int, pos int, t double, mbp double")
    found = events.label_events(df, "mbp", 65.0, 2).orderBy("pos").collect()
    assert [x["label"] for x in found] == [1, 1, 1, 0, 0, 0, 0, 0, 0] and found[0]["event_no"] == 0


@pytest.mark.parametrize(
    "case", ["valid", "low", "event", "earlier", "missing"],
)
def test_validity(spark, case):
    signals = ("mbp", "spo2", "mac")
    config = BuildConfig(signals=signals, half_times=(20,), step=1, observation=40, leading=11, prediction=49, shift=1, min_event=2, smooth=1, recovery=20)
    assert config.length == 100
    rows = [[1, k, float(k), 100.0, 97.0, None, 0] for k in range(130)]
    if case == "low":
        for k in range(40, 50):
            rows[k][3] = 35.0
    if case == "event":
        rows[23][6] = rows[24][6] = 1
    if case == "earlier":
        rows[15][6] = 1
    if case == "missing":
        for k in range(30, 51):
            rows[k][4] = None
    df = frame(spark, [tuple(x) for x in rows], "caseid int, pos int, t double, mbp double, spo2 double, mac double, label int")
    found = segments.validity(df, config).where("pos = 20").first()
    rules = [found[c] for c in ("in_bounds", "no_event_before", "recovered", "enough_data")]
    bad = {"valid": None, "low": 0, "event": 1, "earlier": 2, "missing": 3}[case]
    assert rules == [k != bad for k in range(4)]


def test_resample_against_a_loop(spark):
    rnd = random.Random(5)
    rows = []
    for case in range(6):
        t0 = rnd.randrange(1000)
        times = sorted(rnd.sample(range(200), rnd.randrange(2, 40)))
        rows += [(case, t0 + t, k, None if rnd.random() < 0.3 else rnd.randrange(100) / 1.0) for k, t in enumerate(times)]
    df = frame(spark, rows, "caseid int, t long, event_id int, v double")
    for how in ("last", "median"):
        want = {}
        for case in range(6):
            own = [x for x in rows if x[0] == case]
            t0 = own[0][1]
            cells: dict[int, list] = {}
            for _, t, _, v in own:
                b = (t - t0) // 7 if how == "last" else -(-(t - t0) // 7)
                cells.setdefault(b, []).append(v)
            for b in range(max(cells) + 1):
                there = [v for v in cells.get(b, []) if v is not None]
                want[case, b] = (there[-1] if how == "last" else float(np.median(there))) if there else None
        got = {(x["caseid"], x["pos"]): x["v"] for x in resample.resample(df, 7, ["v"], how, tie="event_id").collect()}
        assert got == want


def test_interpolation_and_trim(spark):
    values = [None, 4.0, None, None, 10.0, None, None]
    df = frame(spark, [(1, k, v) for k, v in enumerate(values)], "caseid int, pos int, mbp double")
    got = [x["mbp"] for x in preprocess.interpolate(df, ["mbp"]).orderBy("pos").collect()]
    assert got == [None, 4.0, 6.0, 8.0, 10.0, 10.0, 10.0]
    kept = preprocess.trim_edges(df, "mbp").orderBy("pos").collect()
    assert [(x["pos"], x["mbp"]) for x in kept] == [(0, 4.0), (1, None), (2, None), (3, 10.0)]


@pytest.mark.parametrize("rows", [6, 80])
def test_trends_short_and_long_frames(spark, rows):
    rnd = np.random.default_rng(1)
    values = rnd.normal(80, 10, 200)
    config = BuildConfig(half_times=(rows,), step=1, observation=90, leading=2, prediction=5, shift=1, min_event=2, smooth=1, recovery=0)
    df = frame(spark, [(1, k, float(v)) for k, v in enumerate(values)], "caseid int, pos int, mbp double")
    found = segments.trends(df, config).orderBy("pos").collect()
    for start in (0, 13, 77):
        y = values[start + 90 - rows : start + 90]
        x = np.arange(-rows, 0)
        slope, constant = np.polyfit(x, y, 1)
        std = np.std(y - constant - slope * x, ddof=1)
        got = [found[start][f"mbp_{kind}_{rows}"] for kind in ("constant", "slope", "std")]
        assert np.allclose(got, [constant, slope, std], rtol=1e-8)


def test_lead_zero_lets_the_last_observation_row_be_positive(spark):
    config = BuildConfig(half_times=(2,), step=1, observation=5, leading=0, prediction=3, shift=1, min_event=1, smooth=1, recovery=0)
    assert config.lead == -1
    labels = [0, 0, 0, 0, 1, 0, 0, 0, 0, 0]
    df = frame(spark, [(1, k, k, 80.0, x, 1 if x else None) for k, x in enumerate(labels)], "caseid int, pos int, t int, mbp double, label int, event_no int")
    row = segments.validity(segments.outcomes(df, config), config).where("pos = 0").first()
    assert row["no_event_before"] and row["seg_label"] == 1 and row["time_before_event"] == 0


def test_cohort_nulls(spark):
    rows = [(1, 40, 7200, "Lobectomy", "Thoracic", 0, None), (2, 18, 7200, "a", "b", 0, 1.0), (3, 40, 7200, None, "b", 0, 1.0), (4, 40, 7200, "Liver TRANSPLANTation", "b", 0, 1.0), (5, 40, 7200, "a", "b", 0, 400.0)]
    df = frame(spark, rows, "caseid int, age int, caseend int, opname string, optype string, emop int, intraop_ebl float")
    assert [x["caseid"] for x in cohort.eligible(df).collect()] == [1]


def test_splits(spark):
    df = frame(spark, [(k, 10 + k % 3, k % 4) for k in range(20)], "caseid int, segment_count long, label_count long")
    split = splits.ordered_split(df)
    assert {x["caseid"] for x in split.where("split = 'train'").collect()} == set(range(14))
    sizes = {x["cv_split"]: x["count"] for x in splits.folds(split).groupBy("cv_split").count().collect()}
    assert sizes == {"cv_0": 5, "cv_1": 5, "cv_2": 4, "test": 6}
    found = splits.search_folds(split, 3, 20)
    assert set(found) == set(range(14)) and set(found.values()) == {0, 1, 2}


def test_shapiro_wilk_known_values():
    weights = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0])
    w, p = stats.shapiro_wilk(weights)
    assert abs(w - 0.7888) < 0.002 and abs(p - 0.0067) < 0.002
    assert stats.shapiro_wilk(np.random.default_rng(0).normal(size=300))[1] > 0.05
    assert stats.shapiro_wilk(np.random.default_rng(0).exponential(size=300))[1] < 1e-6


def test_fold_search_ends_at_the_first_seed_with_all_costs_low(spark):
    df = frame(spark, [(k, 10 + k % 5, k % 4) for k in range(40)], "caseid int, segment_count long, label_count long")
    rows = {x["caseid"]: x for x in splits.fold_search(df, 3, 30, (0.05, 0.05), crossed=False).collect()}
    found = None
    for seed in range(1, 31):
        order = sorted(range(40), key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())
        parts = np.array_split(order, 3)
        s, n = np.array([sum(10 + k % 5 for k in p) for p in parts]), np.array([sum(k % 4 for k in p) for p in parts])
        a, b = abs(s / s.sum() - 1 / 3) / 0.05, abs(n / s - n.sum() / s.sum()) / 0.05
        if found is None or a.sum() + b.sum() < found[0]:
            found = a.sum() + b.sum(), seed, parts
        if a.max() < 1 or b.max() < 1:
            break
    assert {x["seed"] for x in rows.values()} == {found[1]}
    assert {k: x["fold"] for k, x in rows.items()} == {int(k): f for f, p in enumerate(found[2]) for k in p}


def test_ranks_with_one_range_and_many(spark):
    df = frame(spark, [(k * k * 1000, k % 2) for k in range(50)], "caseid long, g int")
    got = {x["caseid"]: (x["place"], x["n"]) for x in splits.ranked(df, ["g"]).collect()}
    assert got == {k * k * 1000: (k // 2 + 1, 25) for k in range(50)}


def test_day_seconds(spark):
    from tidewright.functions import series as fx

    row = spark.createDataFrame([(86_400 * 3 + 61,)], "s long").select(fx.day_seconds(F.col("s")).alias("d")).first()
    assert row["d"] == 61


@pytest.mark.parametrize("chunk", [1, 8, 13, 4096])
def test_flattened_in_chunks(spark, chunk):
    """Segments that begin in one chunk and end in the next, a case of exactly a chunk, starts near the end of a case."""
    config = BuildConfig(signals=("mbp", "hr"), half_times=(4,), step=1, observation=8, leading=2, prediction=3, shift=1, min_event=2, smooth=1, recovery=0)
    draw = random.Random(5)
    cases = {1: 50, 2: 8, 3: 16, 4: 3}
    table = {(c, k): (draw.random(), None if draw.random() < 0.2 else draw.random()) for c, n in cases.items() for k in range(n)}
    df = frame(spark, [(c, k, *v, k % 3 == 0) for (c, k), v in table.items()], "caseid int, pos int, mbp double, hr double, start boolean").repartition(3)
    found = segments.flattened(df, config, F.col("start"), chunk=chunk)
    got = {(x["caseid"], x["pos"]): [x[f"{s}_{k}"] for s in ("mbp", "hr") for k in range(8)] for x in found.collect()}
    none = (None, None)
    assert got == {(c, p): [table.get((c, p + k), none)[i] for i in (0, 1) for k in range(8)] for c, p in table if p % 3 == 0}


def test_no_row_holds_a_case(spark):
    """What is gathered of a case of 5,000 rows is a chunk and an observation at most."""
    config = BuildConfig(signals=("mbp",), half_times=(4,), step=1, observation=8, leading=2, prediction=3, shift=1, min_event=2, smooth=1, recovery=0)
    df = spark.range(5000).select(F.lit(1).alias("caseid"), F.col("id").cast("int").alias("pos"), F.rand(1).alias("mbp"))
    gathered = segments.chunks(df, config, F.lit(True), ["mbp"], 100).select(F.size("_rows").alias("rows"), F.size("_starts").alias("starts"))
    assert {(x["rows"], x["starts"]) for x in gathered.collect()} == {(107, 100), (100, 100)}
    flat = segments.flattened(df, config, F.lit(True), chunk=100)
    assert flat.agg(F.count("*"), F.count_if(F.col("mbp_7").isNull())).first()[:] == (5000, 7)


@pytest.mark.parametrize("chunk", [64, 100, 4096])
def test_trends_at_kept_rows_equal_those_of_all_rows(spark, chunk):
    rnd = np.random.default_rng(5)
    config = BuildConfig(signals=("mbp", "hr"), half_times=(6, 20, 80), step=1, observation=90, leading=2, prediction=5, shift=1, min_event=2, smooth=1, recovery=0)
    rows = [(c, k, None if rnd.random() < 0.1 else float(rnd.normal(80, 10)), 7.0 if c == 2 else float(rnd.normal(1e6, 3)), k % 7 == c) for c, n in ((1, 500), (2, 95), (3, 230)) for k in range(n)]
    df = frame(spark, rows, "caseid int, pos int, mbp double, hr double, start boolean").where("pos >= 0")
    whole = segments.trends(df, config, [(6, 6), (20, 20)])
    names = [f"{s}_{kind}_{h}" for s in ("mbp", "hr") for kind in ("constant", "slope", "std") for h in (6, 20)]
    inside = F.col("start") & (F.col("pos") + 90 <= F.when(F.col("caseid") == 1, 500).when(F.col("caseid") == 2, 95).otherwise(230))
    want = {(x["caseid"], x["pos"]): [x[c] for c in names] for x in whole.where(inside).collect()}
    got = segments.trends_at(df, config, inside, chunk)
    assert set(got.columns) == {"caseid", "pos", "start", *config.feature_names()}
    got = {(x["caseid"], x["pos"]): [x[c] for c in names] for x in got.collect()}
    assert got.keys() == want.keys() and len(got) > 70
    for at, values in want.items():
        assert [v is None for v in got[at]] == [v is None for v in values]
        assert np.allclose([v for v in got[at] if v is not None], [v for v in values if v is not None], rtol=1e-6, atol=1e-4)
