"""Digests of tables and models, and results that are only made when something they rest on has changed."""

from __future__ import annotations

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidewright.sources.tables import current_results, digest, digest_saved_model


def test_digest(spark):
    rows = [(1, "a", None, [1.0]), (2, None, "b", []), (2, None, "b", []), (None, None, None, None)]
    schema = "k int, x string, y string, z array<double>"
    df = spark.createDataFrame(rows, schema)
    same = [df.repartition(3, "x"), df.orderBy(F.desc("k")), df.select("z", "y", "x", "k")]
    assert {digest(x) for x in same} == {digest(df)}
    swapped = [(k, y, x, z) for k, x, y, z in rows]
    others = [
        spark.createDataFrame(rows[:3], schema), spark.createDataFrame([*rows, rows[1]], schema), spark.createDataFrame([*rows[:1], *rows[3:]], schema),
        spark.createDataFrame(swapped, schema), df.withColumn("k", F.col("k").cast("long")), df.withColumnRenamed("x", "w"), df.limit(0),
        df.withColumn("z", F.when(F.col("k") == 1, F.array(F.lit(1.5))).otherwise(F.col("z"))),
    ]
    assert len({digest(x) for x in [df, *others]}) == len(others) + 1


@pytest.fixture(scope="module")
def train(spark):
    draw = random.Random(1)
    rows = [(draw.gauss(0, 1), draw.gauss(0, 1)) for _ in range(300)]
    return spark.createDataFrame([(a, b, float(a + b + draw.gauss(0, 0.5) > 0)) for a, b in rows], "a double, b double, label double").coalesce(1)


def fitted(train, kind: str, **settings):
    classes = {"trees": GBTClassifier, "line": LogisticRegression}
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), classes[kind](**settings)]).fit(train)


def test_digest_of_models(spark, train, tmp_path):
    """The same fit saved again, or fitted again, has one digest; other settings or other rows have another."""
    made = {
        "first": fitted(train, "trees", maxIter=3, seed=1), "again": fitted(train, "trees", maxIter=3, seed=1), "more": fitted(train, "trees", maxIter=4, seed=1),
        "rows": fitted(train.where("a < 1"), "trees", maxIter=3, seed=1), "line": fitted(train, "line"), "line again": fitted(train, "line"),
        "line rows": fitted(train.where("a < 1"), "line"),
    }
    found = {}
    for name, model in made.items():
        model.write().overwrite().save(f"{tmp_path}/{name}")
        found[name] = digest_saved_model(spark, f"{tmp_path}/{name}")
    made["first"].write().overwrite().save(f"{tmp_path}/first")
    assert digest_saved_model(spark, f"{tmp_path}/first") == found["first"]
    assert found["line"] == found["line again"]
    assert len({found[k] for k in ("first", "more", "rows", "line", "line rows")}) == 5
    assert found["first"] == found["again"]


def test_current_results(spark, train, tmp_path):
    runs = []

    def run(df, threshold=0.5, model="m", force=False):
        def make():
            runs.append(threshold)
            return df.where(F.col("a") > threshold).groupBy("label").agg(F.count("*").alias("n"))

        return sorted(map(tuple, current_results(spark, f"{tmp_path}/kept", make, {"rows": df}, {"one": f"{tmp_path}/{model}"}, {"threshold": threshold}, force).collect()))

    fitted(train, "line").write().save(f"{tmp_path}/m")
    fitted(train, "line", regParam=0.1).write().save(f"{tmp_path}/other")
    first = run(train)
    assert run(train) == first and run(train.repartition(4)) == first and len(runs) == 1
    changed = train.withColumn("a", F.when(F.col("a") > 2, 0.0).otherwise(F.col("a")))
    assert run(changed) != first and len(runs) == 2
    run(train, 0.7)
    run(train, model="other")
    assert len(runs) == 4
    assert run(train) == first and len(runs) == 4
    assert run(train, force=True) == first and len(runs) == 5


def test_broken_run_is_made_again(spark, train, tmp_path):
    def broken():
        return train.select(F.raise_error(F.lit("lost")).cast("int").alias("n"))

    with pytest.raises(Exception, match="lost"):
        current_results(spark, f"{tmp_path}/k", broken, {"rows": train}).collect()
    assert current_results(spark, f"{tmp_path}/k", lambda: train.select(F.count("*").alias("n")), {"rows": train}).first()["n"] == 300
