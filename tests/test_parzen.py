"""Parzen search: dimensions, repeatable proposals, failures, and better results than random draws on a known function."""

from __future__ import annotations

import random
from math import log10

import numpy as np
import pytest

from tidewright.operators import parzen

SPACE = {f"x{k}": parzen.Number(-2.0, 3.0) for k in range(6)} | {
    "rate": parzen.Number(1e-5, 1.0, log=True), "n": parzen.Number(1, 50, whole=True), "m": parzen.Number(3, 3, whole=True), "kind": parzen.Choice(("a", "b", "c")),
}


def known(s):
    """Highest, 0, at all x = 0.7, rate = 0.01, n = 20 and kind b."""
    return -sum((s[f"x{k}"] - 0.7) ** 2 for k in range(6)) - (log10(s["rate"]) + 2) ** 2 - ((s["n"] - 20) / 10) ** 2 - 2 * (s["kind"] != "b")


def test_dimensions():
    rnd = random.Random(1)
    for d in SPACE.values():
        if isinstance(d, parzen.Number):
            for place in (-1.0, 0.0, rnd.random(), 1.0, 2.0):
                value = d.value(place)
                assert d.low <= value <= d.high and (not d.whole or isinstance(value, int))
            assert (d.value(0.0), d.value(1.0)) == (d.low, d.high)
            assert d.value(d.place(d.high)) == d.high and 0 <= d.place(d.value(0.3)) <= 1


def test_densities_are_drawn_as_they_are_rated():
    places, rng = np.array([0.1, 0.12, 0.15]), np.random.default_rng(1)
    x = parzen._drawn(places, rng, 20_000)
    assert x.min() >= 0 and x.max() <= 1 and (x < 0.4).mean() > 0.55
    rated = parzen._density(places, np.array([0.12, 0.9]))
    assert rated[0] > 3 * rated[1] > 0


def test_beats_random_draws(spark):
    best, drawn = [], []
    for seed in range(12):
        found = parzen.search(spark, SPACE, known, 80, seed)
        assert len(found) == 80 and found[0][0] != found[1][0]
        best.append(max(v for _, v in found))
        rng = np.random.default_rng(seed + 100)
        rows = [{n: d.values[int(rng.integers(3))] if isinstance(d, parzen.Choice) else d.value(rng.random()) for n, d in SPACE.items()} for _ in range(80)]
        drawn.append(max(map(known, rows)))
    assert np.mean(best) > np.mean(drawn) + 1 and np.median(best) > np.median(drawn) + 1


def test_trials_are_repeatable_whatever_ends_first(spark):
    import time

    def slow(s):
        time.sleep(random.random() / 200)
        if s["kind"] == "c":
            raise RuntimeError("no such kind")
        return known(s)

    one, two = parzen.search(spark, SPACE, slow, 30, 5), parzen.search(spark, SPACE, slow, 30, 5)
    assert one == two and any(v is None for _, v in one) and one != parzen.search(spark, SPACE, known, 30, 6)
    assert sum(s["kind"] == "c" for s, _ in one[12:]) <= 4
    with pytest.raises(RuntimeError, match="no such kind"):
        parzen.search(spark, SPACE | {"kind": parzen.Choice(("c",))}, slow, 3)
