"""Search of settings with tree-structured Parzen estimators, trials fitted side by side.

After some random trials, the better part of the trials gives one density over each dimension and the rest another; a
proposal is the candidate, drawn from the first, for which their ratio is highest. Only settings and their values are on the
driver, a few hundred at most; every trial is Spark work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil, erf, exp, log, sqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import areas, curve
from .ml import boosted, scored, side_by_side


@dataclass(frozen=True)
class Number:
    """A dimension from low to high, both included; log spreads it over orders of magnitude, whole rounds it."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def place(self, value: float) -> float:
        """A value as a place from 0 to 1."""
        low, high, x = (log(v) if self.log else float(v) for v in (self.low, self.high, value))
        return (x - low) / (high - low) if high > low else 0.5

    def value(self, place: float) -> float | int:
        low, high = (log(v) if self.log else float(v) for v in (self.low, self.high))
        x = low + min(max(place, 0.0), 1.0) * (high - low)
        x = min(max(exp(x) if self.log else x, self.low), self.high)
        return int(round(x)) if self.whole else x


@dataclass(frozen=True)
class Choice:
    """A dimension of a few values without an order."""

    values: tuple


Space = dict[str, Number | Choice]

#: Random trials before the densities are used, candidates of a proposal, and the most trials that count as better.
START, CANDIDATES, BETTER = 10, 24, 25


def _bumps(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal bumps at the places and a wide one in the middle: centres, widths (the larger gap to a neighbour), mass in 0 to 1."""
    centre = np.sort(np.append(places, 0.5))
    gaps = np.diff(np.concatenate([[0.0], centre, [1.0]]))
    width = np.clip(np.maximum(gaps[:-1], gaps[1:]), 1.0 / min(100, 1 + len(centre)), 1.0)
    width[np.searchsorted(centre, 0.5)] = 1.0
    below = lambda x: np.array([0.5 * (1 + erf((x - c) / w / sqrt(2))) for c, w in zip(centre, width, strict=True)])
    return centre, width, below(1.0) - below(0.0)


def _density(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The mixture of the bumps, each cut to 0 to 1."""
    centre, width, mass = _bumps(places)
    return (np.exp(-0.5 * ((at[:, None] - centre) / width) ** 2) / width / mass).mean(1)


def _drawn(places: np.ndarray, rng: np.random.Generator, n: int) -> np.ndarray:
    """Draws from _density(): each from one bump, again while it falls outside."""
    centre, width, _ = _bumps(places)
    pick = rng.integers(0, len(centre), n)
    x = rng.normal(centre[pick], width[pick])
    while (outside := (x < 0) | (x > 1)).any():
        x[outside] = rng.normal(centre[pick[outside]], width[pick[outside]])
    return x


def proposed(space: Space, trials: Sequence[tuple[dict, float | None]], seed: int, number: int) -> dict:
    """The setting of trial ``number``, given the trials so far (setting, value; the higher the better).

    Values that are not known yet or failed (None) count as the worst, so trials that run side by side keep apart. The same
    space, trials, seed and number give the same setting.
    """
    rng = np.random.default_rng([seed, number])
    known = sum(v is not None for _, v in trials)
    if known < START:
        return {name: d.values[int(rng.integers(len(d.values)))] if isinstance(d, Choice) else d.value(rng.random()) for name, d in space.items()}
    order = sorted(range(len(trials)), key=lambda k: (trials[k][1] is None, -(trials[k][1] or 0.0), k))
    better = min(BETTER, ceil(0.1 * known) + 1)
    good, bad = [trials[k][0] for k in order[:better]], [trials[k][0] for k in order[better:]]
    found = {}
    for name, d in space.items():
        if isinstance(d, Choice):
            shares = [np.array([1.0 + sum(t[name] == v for t in side) for v in d.values]) for side in (good, bad)]
            shares = [x / x.sum() for x in shares]
            picks = rng.choice(len(d.values), CANDIDATES, p=shares[0])
            found[name] = d.values[int(picks[np.argmax((shares[0] / shares[1])[picks])])]
        else:
            own, other = (np.array([d.place(t[name]) for t in side]) for side in (good, bad))
            candidates = _drawn(own, rng, CANDIDATES)
            found[name] = d.value(float(candidates[np.argmax(_density(own, candidates) / _density(other, candidates))]))
    return found


def search(spark: SparkSession, space: Space, objective: Callable[[dict], float], trials: int = 100, seed: int = 42, at_once: int = 4) -> list[tuple[dict, float | None]]:
    """All trials (setting, value) in their order; ``at_once`` run side by side, and each round proposes from those before it.

    A trial that raises an error counts as None, the worst; if all do, the last error is raised. For the same seed and
    at_once the settings are the same, whatever trial ends first.
    """
    done: list[tuple[dict, float | None]] = []
    failed: Exception | None = None

    def tried(setting: dict) -> float | Exception:
        try:
            return float(objective(setting))
        except Exception as error:  # noqa: BLE001  whatever a trial's work raises
            return error

    while len(done) < trials:
        batch: list[tuple[dict, float | None]] = []
        for k in range(min(at_once, trials - len(done))):
            batch.append((proposed(space, [*done, *batch], seed, len(done) + k), None))
        values = side_by_side(spark, [lambda s=s: tried(s) for s, _ in batch], at_once)
        failed = next((v for v in values if isinstance(v, Exception)), failed)
        done += [(s, None if isinstance(v, Exception) else v) for (s, _), v in zip(batch, values, strict=True)]
    if failed and all(v is None for _, v in done):
        raise failed
    return done


#: Dimensions of boosted trees, by the names of boosted()'s arguments.
TREES: Space = {
    "depth": Number(1, 9, whole=True),
    "step": Number(0.001, 0.1, log=True),
    "trees": Number(50, 500, whole=True),
    "minInstancesPerNode": Number(1, 10, whole=True),
    "minInfoGain": Number(1e-8, 1.0, log=True),
    "subsamplingRate": Number(0.6, 1.0),
    "featureSubsetStrategy": Number(0.01, 1.0, log=True),
}


def tuned_trees(
    train: DataFrame, features: Sequence[str], folds: Sequence[str], trials: int = 100, seed: int = 42, space: Space | None = None, label: str = "label", at_once: int = 4
) -> DataFrame:
    """trial, parameters (text) and average_precision, the mean over folds (cv_split) of each trial; the best first."""
    spark = train.sparkSession

    def objective(setting: dict) -> float:
        more = {k: str(v) if k == "featureSubsetStrategy" else v for k, v in setting.items()}
        values = []
        for fold in folds:
            model = boosted(train.where(F.col("cv_split") != fold), features, label, **more)
            held = scored(model, train.where(F.col("cv_split") == fold)).select(F.col(label).alias("y"), "score", "label_id")
            values.append(areas(curve(held)).first()["average_precision"] or 0.0)
        return sum(values) / len(values)

    found = search(spark, space or TREES, objective, trials, seed, at_once)
    rows = [(k, str(sorted(s.items())), v) for k, (s, v) in enumerate(found)]
    return spark.createDataFrame(rows, "trial int, parameters string, average_precision double").orderBy(F.desc_nulls_last("average_precision"), "trial")
