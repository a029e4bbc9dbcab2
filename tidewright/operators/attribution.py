"""Attributions of boosted trees: how much each feature moves a row's margin from the model's base value.

A model's trees are a small table of leaves. A leaf's path has, for each feature on it, the interval that leads there and the
share of training rows that take it; a row follows the feature (1), or, where the feature is unknown, goes along with
that share. A feature's attribution is its Shapley value in that game, summed over leaves: the average over all orders of
features, worked out with a polynomial in the number of known features instead of subsets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import comb, inf

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .ml import assembled

#: Rows that are worked on at once.
AT_ONCE = 4096


@dataclass(frozen=True)
class Leaf:
    """A leaf's value (tree weight included), and for each feature on its path (place, low, high, share of rows)."""

    value: float
    path: tuple[tuple[int, float, float, float], ...]


def leaves(model: PipelineModel) -> list[Leaf]:
    """The leaves of a boosted model's trees. Splits send values up to the threshold left, others right."""
    trees = model.stages[-1]
    found: list[Leaf] = []

    def walk(node, weight: float, path: dict[int, tuple[float, float, float]]) -> None:
        if not node.subtreeDepth():
            found.append(Leaf(weight * node.prediction(), tuple((k, *v) for k, v in sorted(path.items()))))
            return
        split, rows = node.split(), node.impurityStats().count()
        feature, cut = split.featureIndex(), split.threshold()
        low, high, share = path.get(feature, (-inf, inf, 1.0))
        for child, edges in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
            walk(child, weight, path | {feature: (*edges, share * child.impurityStats().count() / rows)})

    for tree, weight in zip(trees.trees, trees.treeWeights, strict=True):
        walk(tree._java_obj.rootNode(), weight, {})
    return found


def base(found: Sequence[Leaf]) -> float:
    """The margin of a row of which nothing is known: the leaves' values by their shares of rows."""
    return float(sum(leaf.value * np.prod([share for *_, share in leaf.path]) for leaf in found))


def attributions(found: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """The attribution of each feature for each row of x; a row's sum to its margin less base(found).

    On a leaf's path with d features, let p be the product of (share + follows * t) over the others: the coefficient of t ** s
    holds all sets of s known features, and each such set counts with the weight 1 / (d * C(d - 1, s)).
    """
    out = np.zeros(x.shape)
    for leaf in found:
        d = len(leaf.path)
        follows = [((x[:, k] > low) & (x[:, k] <= high)).astype(np.float64) for k, low, high, _ in leaf.path]
        shares = [share for *_, share in leaf.path]
        for own, (feature, *_) in enumerate(leaf.path):
            terms = [np.ones(len(x))]
            for other in range(d):
                if other == own:
                    continue
                more = [shares[other] * c for c in terms] + [np.zeros(len(x))]
                for s, c in enumerate(terms):
                    more[s + 1] = more[s + 1] + follows[other] * c
                terms = more
            weighed = sum(c / (d * comb(d - 1, s)) for s, c in enumerate(terms))
            out[:, feature] += leaf.value * (follows[own] - shares[own]) * weighed
    return out


def attributed(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with margin, base, and attribution_{feature} for each feature: margin = base + their sum.

    The leaves travel to the tasks, a few hundred a tree; rows stay where they are. Rows with a null feature are left out,
    as in scored(). Columns of df with the new names are replaced.
    """
    found, names = leaves(model), [f"attribution_{f}" for f in features]
    start = base(found)
    added = [StructField(c, DoubleType()) for c in ("margin", "base", *names)]
    taken = {f.name for f in added}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in taken])
    columns = assembled(model)
    if list(features) != columns:
        raise ValueError(f"the model was fitted with {columns}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(low, AT_ONCE)
                x = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1)
                values = attributions(found, x)
                made = [start + values.sum(1), np.full(len(x), start), *values.T]
                arrays = [*batch.columns, *[pa.array(np.ascontiguousarray(v)) for v in made]]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *[f.name for f in added]])

    rows = df.dropna(subset=list(features))
    return rows.mapInArrow(run, StructType([*df.schema, *added]))


def ranked(attributed_rows: DataFrame, features: Sequence[str], k: int = 10) -> DataFrame:
    """The k features of the largest mean absolute attribution: feature, mean_abs, and the share of rows it raises."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`attribution_{f}`").alias("v")) for f in features]))
    rows = attributed_rows.select(each.alias("x"))
    found = rows.groupBy("x.feature").agg(F.avg(F.abs("x.v")).alias("mean_abs"), F.avg((F.col("x.v") > 0).cast("double")).alias("share_up"))
    return found.orderBy(F.desc("mean_abs"), "feature").limit(k)
