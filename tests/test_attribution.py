"""Tree attributions against the average over all subsets of known features."""

from __future__ import annotations

import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import attribution, ml

NAMES = ["a", "b", "c", "d", "e", "f"]


@pytest.fixture(scope="module")
def fitted(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(600):
        x = [round(rnd.gauss(0, 1), 2) for _ in NAMES]
        rows.append((k, int(x[0] + x[1] * x[2] > 0.5 or x[3] > 1.2 and x[4] < 0), *x))
    df = spark.createDataFrame(rows, "k int, label int, " + ", ".join(f"{c} double" for c in NAMES))
    return df, ml.boosted(df, NAMES, trees=6, depth=4)


def tree_value(node, x, known):
    """The expected prediction below a node with some features known, down the model's own nodes."""
    if not node.subtreeDepth():
        return node.prediction()
    split = node.split()
    left, right = node.leftChild(), node.rightChild()
    if split.featureIndex() in known:
        return tree_value(left if x[split.featureIndex()] <= split.threshold() else right, x, known)
    n = left.impurityStats().count(), right.impurityStats().count()
    return (n[0] * tree_value(left, x, known) + n[1] * tree_value(right, x, known)) / sum(n)


def by_subsets(model, x):
    trees = [(t._java_obj.rootNode(), w) for t, w in zip(model.stages[-1].trees, model.stages[-1].treeWeights, strict=True)]
    d = len(NAMES)
    value = {s: sum(w * tree_value(t, x, s) for t, w in trees) for n in range(d + 1) for s in combinations(range(d), n)}
    out = []
    for k in range(d):
        total = 0.0
        for s in value:
            if k not in s:
                weight = factorial(len(s)) * factorial(d - len(s) - 1) / factorial(d)
                total += weight * (value[tuple(sorted((*s, k)))] - value[s])
        out.append(total)
    return out, value[()], value[tuple(range(d))]


def test_against_all_subsets(spark, fitted):
    df, model = fitted
    found = attribution.leaves(model)
    assert any(len(leaf.path) < 4 for leaf in found) and len(found) > 40
    rows = df.limit(3).collect()
    got = attribution.attributions(found, np.array([[x[c] for c in NAMES] for x in rows]))
    for x, values in zip(rows, got, strict=True):
        want, start, whole = by_subsets(model, [x[c] for c in NAMES])
        assert values.tolist() == pytest.approx(want) and attribution.base(found) == pytest.approx(start)
        assert start + sum(values) == pytest.approx(whole)


def test_values_add_up_to_the_score(spark, fitted):
    df, model = fitted
    odd = df.union(spark.createDataFrame([(9000, 1, None, 1.0, 1.0, 1.0, 1.0, 1.0)], df.schema)).withColumns({"margin": F.lit("x"), "of, a": F.lit(1)})
    got = attribution.attributed(model, odd, NAMES)
    assert got.columns == ["k", "label", *NAMES, "of, a", "margin", "base", *[f"attribution_{c}" for c in NAMES]]
    scores = {x["k"]: x["score"] for x in ml.scored(model, df).collect()}
    rows = got.collect()
    assert {x["k"] for x in rows} == set(scores)
    for x in rows:
        assert x["base"] + sum(x[f"attribution_{c}"] for c in NAMES) == pytest.approx(x["margin"])
        assert 1 / (1 + np.exp(-2 * x["margin"])) == pytest.approx(scores[x["k"]])
    top = attribution.ranked(got, NAMES, 2).collect()
    means = {c: np.mean([abs(x[f"attribution_{c}"]) for x in rows]) for c in NAMES}
    assert [x["feature"] for x in top] == sorted(means, key=means.get, reverse=True)[:2]
    assert top[0]["mean_abs"] == pytest.approx(max(means.values()))
    with pytest.raises(ValueError, match="fitted with"):
        attribution.attributed(model, df, NAMES[::-1])


def test_no_rows(fitted):
    df, model = fitted
    assert attribution.attributed(model, df.limit(0), NAMES).count() == 0
