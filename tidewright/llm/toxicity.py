"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words and word stems (first bytes), pairs of neighbours, and pairs with one word between,
each hashed to one of 2**BITS coordinates. Each coordinate has a learning rate of its own; L1 keeps most weights at zero, so the model is a
few thousand (coordinate, weight) rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes
from .common import lean, small, text_keys, written

BITS = 20
#: Labelled documents that the model is fitted on at most: those first by a hash of doc_id.
SAMPLE = 12_000
#: Bytes of the word stems, which carry a word's inflections.
STEMS = (4, 6)
_SHIFT = np.uint64(64 - BITS)


@dataclass(frozen=True)
class Ftrl:
    """alpha and beta set the rates, l1 the sparsity; epochs passes over the sample."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.05
    epochs: int = 12


def features(block: textbytes.Block) -> list[np.ndarray]:
    """The distinct coordinates of each text of a block, sorted."""
    value, at, stems = textbytes.words_and_stems(block, textbytes.NOT_ALNUM, STEMS)
    if not len(value):
        return [np.zeros(0, np.int64)] * (len(at) - 1)
    one = value >> _SHIFT
    two = textbytes.mixed(value[:-1] * np.uint64(3) + value[1:]) >> _SHIFT
    skip = textbytes.mixed(value[:-2] * np.uint64(5) + value[2:] + np.uint64(1)) >> _SHIFT
    begins = [(textbytes.mixed(x + np.uint64(k)) >> _SHIFT, begin) for (x, begin), k in zip(stems, STEMS, strict=True)]
    found = []
    for k in range(len(at) - 1):
        a, b = int(at[k]), int(at[k + 1])
        parts = [one[a:b], two[a : max(a, b - 1)], skip[a : max(a, b - 2)], *[x[y[k] : y[k + 1]] for x, y in begins]]
        found.append(np.unique(np.concatenate(parts)).astype(np.int64))
    return found


def fit(rows: list[np.ndarray], labels: list[int], how: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates with a weight, and the weights; coordinate 2**BITS is the intercept."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(7)

    def weight(k: np.ndarray) -> np.ndarray:
        zk = z[k]
        l1 = np.where(k == 1 << BITS, 0.0, how.l1)
        return np.where(np.abs(zk) <= l1, 0.0, -(zk - np.sign(zk) * l1) / ((how.beta + np.sqrt(n[k])) / how.alpha + how.l2))

    rows = [np.append(x, 1 << BITS) for x in rows]
    for _ in range(how.epochs):
        for k in order.permutation(len(rows)).tolist():
            x = rows[k]
            w = weight(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            nx = n[x]
            z[x] += g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / how.alpha * w
            n[x] = nx + g * g
    every = np.arange((1 << BITS) + 1)
    w = weight(every)
    return every[w != 0], w[w != 0]


def train(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, how: Ftrl = Ftrl()) -> DataFrame:
    """The model (coordinate int, weight double) from docs (doc_id, text) and labels (doc_id, label 0 or 1).

    It is fitted in one task on at most ``sample`` labelled documents, a documented bound. Null labels and ids are
    left out; a doc_id labelled twice has the larger label; a doc_id with several texts has the first by a hash.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "toxicity-sample")
    rows = docs.select("doc_id", "text").join(small(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(*text_keys(F.col("text")))).alias("text"), F.first("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            ids, ys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for block in textbytes.blocks(batch.column(1)):
                found += zip(ids[block.first : block.last], ys[block.first : block.last], features(block), strict=True)
        found.sort(key=lambda x: x[0])
        at, weight = fit([x[2] for x in found], [x[1] for x in found], how)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(weight, pa.float64())], ["coordinate", "weight"])

    one = lean(rows.select("doc_id", "text", "y")).coalesce(1)
    return written(one.mapInArrow(run, "coordinate int, weight double"), "toxicity-model")


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """docs (doc_id, text) with score, the probability of label 1; null and empty texts have the intercept's.

    The model has at most 2**BITS + 1 rows, so it is sent to every executor.
    """
    rows = model.toPandas()
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[rows["coordinate"].to_numpy()] = rows["weight"].to_numpy()
    kept = np.flatnonzero(weights).astype(np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((kept, weights[kept]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        table = np.zeros((1 << BITS) + 1, np.float32)
        table[at] = w
        for batch in batches:
            for block in textbytes.blocks(batch.column(1)):
                total = np.array([table[x].sum(dtype=np.float64) for x in features(block)]) + float(table[1 << BITS])
                made = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(made)), pa.array(made)], ["doc_id", "score"])

    return lean(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's text, modulo folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score and predicted.

    The model learns from labelled documents outside fold 0 alone; held_out marks fold 0. Without any label, or with
    an empty table, scores are 0.5. Null and empty texts have the intercept's score, texts of any length count whole.
    Repeated rows are scored alike, a score of 0.5 counts as 1; other columns, whatever their names, are left out.
    """
    learn = labels.where(fold(F.col("doc_id")) != 0)
    scored = score(docs, train(docs, learn, label))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
