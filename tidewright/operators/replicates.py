"""Bootstrap replicates as vectors: each row has the numbers of its copies in all replicates, drawn from a hash of its key.

Nothing is multiplied by the number of replicates: rows are dealt in ranges of the score, a task adds up its rows' vectors
from the highest score down, and what tasks exchange is a few vectors a range. So every curve of every replicate is
exact, and its areas and its point of operation are known after two passes over the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..sources.tables import staged
from .metrics import derived

#: Draws are 16 bits of a hash: a row has as many copies as there are cuts at or below its draw (Poisson with mean 1).
BITS = 16
# Fixed values of the Poisson distribution function at 0, 1, 2, ... in 65536ths, rounded.
CUTS = (24109, 48219, 60273, 64291, 65296, 65497, 65531, 65535)

#: Draws of one md5.
EACH = 128 // BITS
#: Rows whose vectors are held at once.
AT_ONCE = 2048

METRICS = ("auroc", "average_precision", "auprc", "threshold", "precision", "event_recall", "specificity", "npv", "f1")
STRATEGIES = ("max_precision", "targeted_precision", "targeted_recall", "fixed_threshold")


def copies(keys: list[str], replicates: int) -> np.ndarray:
    """Copies of each key in each replicate: replicate b has the draw b % 8 of the md5 of the key, a colon and b div 8."""
    n = -(-replicates // EACH)
    raw = b"".join(hashlib.md5(f"{key}:{k}".encode(), usedforsecurity=False).digest() for key in keys for k in range(n))
    draws = np.frombuffer(raw, ">u2").reshape(len(keys), n * EACH)[:, :replicates]
    return np.searchsorted(np.array(CUTS), draws, "right").astype(np.int64)


#: Rows of a task: keys, y, scores, and the last column.
Rows = tuple[list[str], np.ndarray, np.ndarray, list]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """The rows (key, y, score, one more) of batches, AT_ONCE at most at a time."""
    for whole in batches:
        for low in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(low, AT_ONCE)
            yield batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy(), batch.column(3).to_pylist()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[Rows]]]:
    """Each part's rows (key, y, score, first, part), which come one part after the other."""

    def cut() -> Iterator[tuple[int, pa.RecordBatch]]:
        for whole in batches:
            part = whole.column(4).to_numpy()
            edge = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for low, high in zip(edge, edge[1:], strict=False):
                if high > low:
                    yield int(part[low]), whole.slice(low, high - low)

    for part, own in groupby(cut(), itemgetter(0)):
        yield part, _slices(batch for _, batch in own)


def _firsts(rows: DataFrame, replicates: int) -> DataFrame:
    """Positive rows (key, y, score, label_id) with first, a bit for each replicate in which the row is its event's best.

    An event's rows come one after the other from the best down, and what is kept of them is a bit a replicate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        event, seen = None, np.zeros(replicates, bool)
        for keys, y, score, labels in _slices(batches):
            drawn = copies(keys, replicates) > 0
            first = np.zeros_like(drawn)
            for k, label in enumerate(labels):
                if label != event:
                    event, seen = label, np.zeros(replicates, bool)
                first[k] = drawn[k] & ~seen
                seen = seen | drawn[k]
            bits = [x.tobytes() for x in np.packbits(first, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(y, pa.int32()), pa.array(score), pa.array(bits, pa.binary())], ["key", "y", "score", "first"])

    named = rows.select("key", "y", "score", F.coalesce(F.concat(F.lit("="), F.col("label_id").cast("string")), F.lit("-")).alias("label"))
    ordered = named.repartition("label").sortWithinPartitions("label", F.desc("score"), "key")
    return ordered.mapInArrow(run, "key string, y int, score double, first binary")


def _vectors(rows: Rows, replicates: int) -> np.ndarray:
    """Copies of each row as positives, as negatives, and the events it is first of: (rows, 3, replicates)."""
    keys, y, _, first = rows
    drawn = copies(keys, replicates)
    out = np.zeros((len(keys), 3, replicates), np.int64)
    out[:, 0] = drawn * y[:, None]
    out[:, 1] = drawn * (1 - y)[:, None]
    known = [k for k, x in enumerate(first) if x is not None]
    if known:
        bits = np.frombuffer(b"".join(first[k] for k in known), np.uint8).reshape(len(known), -1)
        out[known, 2] = np.unpackbits(bits, axis=1, count=replicates)
    return out


def _totals(rows: DataFrame, replicates: int) -> DataFrame:
    """Of each part of the rows: its highest and lowest score, its vectors' sums, and those of its lowest score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _parts(batches):
            high = low = None
            whole = lowest = np.zeros((3, replicates), np.int64)
            for rows in own:
                score, vectors = rows[2], _vectors(rows, replicates)
                high = score[0] if high is None else high
                lowest = (lowest if low == score[-1] else 0) + vectors[score == score[-1]].sum(0)
                low, whole = score[-1], whole + vectors.sum(0)
            arrays = [pa.array([part], pa.int32()), pa.array([high]), pa.array([low]), pa.array([whole.tobytes()], pa.binary()), pa.array([lowest.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "high", "low", "whole", "lowest"])

    return rows.mapInArrow(run, "part int, high double, low double, whole binary, lowest binary")


@dataclass
class _Start:
    """What a part has to know: the sums of the parts above, of those its first score's, whether its last score goes on below."""

    before: np.ndarray
    begun: np.ndarray
    goes_on: bool


def _starts(totals: list[Row], replicates: int) -> tuple[dict[int, _Start], np.ndarray]:
    """The start of each part, from the highest scores down, and the sums of all rows."""
    ordered = sorted(totals, key=lambda x: -x["part"])
    vectors = lambda raw: np.frombuffer(raw, np.int64).reshape(3, replicates)
    before = open_ = np.zeros((3, replicates), np.int64)
    score, found = None, {}
    for k, x in enumerate(ordered):
        begun = open_ if x["high"] == score else np.zeros_like(before)
        found[x["part"]] = _Start(before, begun, k + 1 < len(ordered) and ordered[k + 1]["high"] == x["low"])
        open_ = vectors(x["lowest"]) + (begun if x["high"] == x["low"] else 0)
        score, before = x["low"], before + vectors(x["whole"])
    return found, before


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b > 0, a / np.where(b > 0, b, 1), np.nan)


class _Sums:
    """The areas and the best point of each replicate over the scores of a part."""

    def __init__(self, replicates: int, totals: np.ndarray, strategy: str, value: float) -> None:
        self.totals, self.strategy, self.value = totals, strategy, value
        self.areas = np.zeros((3, replicates))
        self.best = np.full(replicates, np.inf)
        self.point = np.full((3, replicates), np.nan)

    def add(self, scores: np.ndarray, here: np.ndarray, above: np.ndarray) -> None:
        """here and above: running sums (scores, 3, replicates) with and without each score's rows."""
        pos, neg, events = self.totals
        precision, recall, event, fpr = self._ratios(here, pos, neg, events)
        p0, r0, e0, f0 = self._ratios(above, pos, neg, events)
        drawn = (here[:, 0] + here[:, 1]) > (above[:, 0] + above[:, 1])
        p0 = np.where(np.isnan(p0), 1.0, p0)
        self.areas[0] += np.nan_to_num((fpr - f0) * (recall + r0) / 2).sum(0)
        self.areas[1] += np.nan_to_num((recall - r0) * precision).sum(0)
        self.areas[2] += np.nan_to_num((event - e0) * (precision + p0) / 2).sum(0)
        if self.strategy == "max_precision":
            cost = np.where(drawn & (event > 0.02), -precision, np.inf)
        else:
            of = {"targeted_precision": precision, "targeted_recall": event, "fixed_threshold": np.broadcast_to(scores[:, None], precision.shape)}[self.strategy]
            cost = np.where(drawn & ~np.isnan(of), np.abs(of - self.value), np.inf)
        at = cost.argmin(0)  # scores descend: of equals the highest
        lowest = np.take_along_axis(cost, at[None], 0)[0]
        better = lowest < self.best
        self.best = np.where(better, lowest, self.best)
        found = np.stack([scores[at], np.take_along_axis(precision, at[None], 0)[0], np.take_along_axis(event, at[None], 0)[0]])
        self.point = np.where(better, found, self.point)

    @staticmethod
    def _ratios(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, events: np.ndarray) -> tuple[np.ndarray, ...]:
        tp, fp, hits = x[:, 0], x[:, 1], x[:, 2]
        return _ratio(tp, tp + fp), _ratio(tp, pos), _ratio(hits, events), _ratio(fp, neg)


def _curves(rows: DataFrame, starts: dict[int, _Start], totals: np.ndarray, strategy: str, value: float) -> DataFrame:
    """Each part's share of the areas, and its best point: a row for each replicate."""
    replicates = totals.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _parts(batches):
            start, sums, score = starts[part], _Sums(replicates, totals, strategy, value), None
            below, open_ = start.before - start.begun, start.begun  # above the open score, and of the open score
            for rows in own:
                scores, vectors = rows[2], _vectors(rows, replicates)
                score = scores[0] if score is None else score
                edge = np.flatnonzero(np.concatenate([[scores[0] != score], scores[1:] != scores[:-1]]))
                begin = np.concatenate([[0], edge[edge > 0]])
                each, names = np.add.reduceat(vectors, begin, 0), scores[begin]
                if scores[0] != score:
                    each, names = np.concatenate([open_[None], each]), np.concatenate([[score], names])
                else:
                    each[0] += open_
                score, open_ = names[-1], each[-1]
                if len(names) > 1:
                    here = np.cumsum(each[:-1], 0) + below
                    sums.add(names[:-1], here, here - each[:-1])
                    below = here[-1]
            if not start.goes_on:
                sums.add(np.array([score]), (below + open_)[None], below[None])
            columns = [np.arange(replicates), np.full(replicates, part), *sums.areas, sums.best, *sums.point]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], _COLUMNS)

    return rows.mapInArrow(run, ", ".join(f"{c} {'long' if c in ('boot_id', 'part') else 'double'}" for c in _COLUMNS))


_COLUMNS = ["boot_id", "part", "auroc", "average_precision", "auprc", "cost", "threshold", "precision", "event_recall"]


def evaluated(rows: DataFrame, key: str, replicates: int = 200, strategy: str = "max_precision", value: float = 0.0, ranges: int | None = None) -> DataFrame:
    """boot_id and METRICS of each replicate that has both classes.

    rows has y (0 or 1), score, label_id (of positive rows, null is an event of its own) and a key that names a row; rows
    without a score are left out. A replicate has each row as often as its draw says, so about as many rows as there are. Its
    curve has a point for each score that was drawn; threshold, precision and event_recall are those of the point that the
    strategy picks, as in metrics.pick(), null if there is none; specificity, npv and f1 follow as in metrics.derived(),
    with the replicate's own prevalence of events.

    Rows of one score may lie in several ranges (as many as the session's shuffle partitions), so a common score doesn't fill
    one task. The driver holds the sums of each
    range: ``ranges`` times six numbers a replicate, whatever the number of rows.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.where(F.col("score").isNotNull()).select(
        F.col(f"`{key}`").cast("string").alias("key"), F.col("y").cast("int").alias("y"), F.col("score").cast("double").alias("score"), "label_id"
    )
    negatives = rows.where("y = 0").select("key", "y", "score", F.lit(None).cast("binary").alias("first"))
    dealt = _firsts(rows.where("y = 1"), replicates).union(negatives).repartitionByRange(ranges, "score", "key")
    table = staged(dealt.withColumn("part", F.spark_partition_id()), "replicates")
    ordered = table.repartition(ranges, "part").sortWithinPartitions("part", F.desc("score"))
    starts, totals = _starts(_totals(ordered, replicates).collect(), replicates)
    found = _curves(ordered, starts, totals, strategy, value)
    point = F.min_by(F.struct("threshold", "precision", "event_recall"), F.struct("cost", -F.col("part")))
    found = found.groupBy("boot_id").agg(*[F.sum(c).alias(c) for c in _COLUMNS[2:5]], F.when(F.min("cost") < float("inf"), point).alias("p"))
    sizes = [(b, *(int(x) for x in totals[:, b])) for b in range(replicates)]
    counted = F.broadcast(spark.createDataFrame(sizes, "boot_id long, n_pos long, n_neg long, n_events long"))  # a row a replicate
    found = found.join(counted, "boot_id").where("n_pos > 0 and n_neg > 0").select("boot_id", *_COLUMNS[2:5], "p.*", "n_neg", "n_events")
    return derived(found).select("boot_id", *METRICS)
