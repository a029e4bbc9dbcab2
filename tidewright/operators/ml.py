"""Models: a calibrated single-signal baseline, boosted trees, tuning over case folds, and explanations."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bootstrap import spread
from .metrics import areas, curve, nearest, pick
from .replicates import METRICS, evaluated


def baseline(train: DataFrame, feature: str = "last_map_value", label: str = "label") -> PipelineModel:
    """A linear margin on one signal, calibrated by a logistic fit of the margin."""
    margin = LinearSVC(featuresCol="one", labelCol=label, rawPredictionCol="margin", predictionCol="side", maxIter=20)
    platt = LogisticRegression(featuresCol="margin", labelCol=label, probabilityCol="probability", predictionCol="predicted", rawPredictionCol="raw")
    return Pipeline(stages=[VectorAssembler(inputCols=[feature], outputCol="one"), margin, platt]).fit(train)


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], object]], at_once: int = 4) -> list:
    """The results of driver-side jobs that each run Spark work, ``at_once`` at a time, so that they share the cluster."""
    with ThreadPool(max(1, min(at_once, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs, chunksize=1)


def calibrated_by_folds(train: DataFrame, key: str, feature: str = "last_map_value", label: str = "label", folds: int = 5) -> list[PipelineModel]:
    """Members of an ensemble: for each fold a linear margin that is fitted on the other folds and calibrated on this one.

    A row's fold comes from a hash of its key. Calibration is a logistic fit of the margins that the fold's rows get, towards
    the smoothed targets (n1 + 1) / (n1 + 2) and 1 / (n0 + 2) of its n1 positive and n0 negative rows: each row counts as a
    positive and as a negative with these weights. A fold is left out if it or the rest lacks a class; all left out is an error.
    """
    spark = train.sparkSession
    rows = train.select(F.col(feature).cast("double").alias(feature), F.col(label).cast("double").alias(label), F.pmod(F.xxhash64(key), F.lit(folds)).alias("_fold"))
    rows = rows.dropna()
    counts = {x["_fold"]: (x["n1"], x["n"] - x["n1"]) for x in rows.groupBy("_fold").agg(F.sum(label).alias("n1"), F.count("*").alias("n")).collect()}
    total = [sum(c[k] for c in counts.values()) for k in (0, 1)]
    usable = [k for k, c in sorted(counts.items()) if min(c) > 0 and total[0] > c[0] and total[1] > c[1]]
    if not usable:
        raise ValueError("no fold has both classes inside and outside")

    def fitted(fold: int) -> PipelineModel:
        margin = LinearSVC(featuresCol="one", labelCol=label, rawPredictionCol="margins", predictionCol="side", maxIter=20)
        stages = [VectorAssembler(inputCols=[feature], outputCol="one"), margin, VectorSlicer(inputCol="margins", outputCol="margin", indices=[1])]
        first = Pipeline(stages=stages).fit(rows.where(F.col("_fold") != fold))
        n1, n0 = counts[fold]
        towards = F.when(F.col(label) == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))
        held = first.transform(rows.where(F.col("_fold") == fold)).select("margin", F.explode(F.array(F.struct(F.lit(1.0).alias("to"), towards.alias("w")), F.struct(F.lit(0.0).alias("to"), (1 - towards).alias("w")))).alias("x"))
        held = held.select("margin", F.col("x.to").alias("to"), F.col("x.w").alias("weight"))
        platt = LogisticRegression(featuresCol="margin", labelCol="to", weightCol="weight", predictionCol="predicted", rawPredictionCol="raw", tol=1e-9)
        return PipelineModel([*first.stages, platt.fit(held)])

    return side_by_side(spark, [lambda k=k: fitted(k) for k in usable])


def ensemble_scored(models: Sequence[PipelineModel], df: DataFrame) -> DataFrame:
    """Add score, the mean probability of label 1 over the models."""
    kept = df.columns
    for k, model in enumerate(models):
        df = scored(model, df).withColumnRenamed("score", f"_score_{k}")
    mean = sum((F.col(f"_score_{k}") for k in range(len(models))), F.lit(0.0)) / len(models)
    return df.select(*[F.col(f"`{c}`") for c in kept], mean.alias("score"))


def save_ensemble(models: Sequence[PipelineModel], path: str) -> None:
    """Write an ensemble's models to numbered folders of a shared folder, and how many there are."""
    for k, model in enumerate(models):
        save(model, f"{path}/member-{k}")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps({"members": len(models)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/ensemble")


def load_ensemble(spark: SparkSession, path: str) -> list[PipelineModel]:
    return [load(f"{path}/member-{k}") for k in range(json.loads(spark.read.text(f"{path}/ensemble").first()[0])["members"])]


def boosted(
    train: DataFrame, features: Sequence[str], label: str = "label", trees: int = 10, depth: int = 3, step: float = 0.1, seed: int = 42, **more
) -> PipelineModel:
    """Boosted trees; more goes to GBTClassifier, such as minInstancesPerNode, minInfoGain, subsamplingRate."""
    model = GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, **more)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"), model]).fit(train)


def assembled(model: PipelineModel) -> list[str]:
    """The columns that a model was fitted with, in order."""
    return model.stages[0].getInputCols()


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add score, the probability of label 1."""
    kept = df.columns
    return model.transform(df).select(*kept, vector_to_array("probability")[1].alias("score"))


def save(model: PipelineModel, path: str) -> None:
    """Write a fitted model to a shared folder, over an earlier one."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def evaluation(baseline_scores: DataFrame, model_scores: DataFrame) -> DataFrame:
    """A row for the baseline and the model: areas, and the point of operation.

    Both tables have y, score and label_id. The baseline works at its point of highest precision, the model at the point
    whose event recall is nearest to the baseline's there.
    """
    own, other = curve(baseline_scores), curve(model_scores)
    at = pick(own, "max_precision")
    recall = at.select("event_recall").first()
    theirs = pick(other, "targeted_recall", float(recall["event_recall"]) if recall and recall["event_recall"] is not None else 0.0)
    rows = [(F.lit(name), points, point) for name, points, point in (("baseline", own, at), ("model", other, theirs))]
    found = [areas(points).crossJoin(point).select(name.alias("model"), "average_precision", "auroc", "auprc", "threshold", "precision", "event_recall") for name, points, point in rows]  # one row each
    return found[0].union(found[1])


def replicated_evaluation(baseline_scores: DataFrame, model_scores: Sequence[DataFrame], key: str, replicates: int = 200, signal: str | None = None) -> DataFrame:
    """model, and {metric}_mean, _sd and _median of every metric over bootstrap replicates: a row for the baseline and each model.

    Tables have key, y, score and label_id. Each replicate of the baseline works at its own point of highest precision; the
    models work, replicate by replicate, at the event recall nearest to the median of the baseline's. With ``signal``, a column
    of baseline_scores, also signal_median: of the replicates' thresholds, each as the signal of the row with the nearest score.
    """
    base = evaluated(baseline_scores, key, replicates, "max_precision")
    named = ["threshold_value"] if signal else []
    if signal:
        base = nearest(base, "threshold", baseline_scores.withColumnRenamed(signal, "_signal"), "score", "_signal", key).withColumnRenamed("nearest__signal", "threshold_value")
    rows = spread(base, [*METRICS, *named])
    recall = rows.first()["event_recall_median"] or 0.0
    found = rows.select(F.lit("baseline").alias("model"), "*")
    for k, scores in enumerate(model_scores):
        own = spread(evaluated(scores, key, replicates, "targeted_recall", recall), list(METRICS))
        found = found.unionByName(own.select(F.lit(f"model {k}").alias("model"), "*"), allowMissingColumns=True)
    return found


def lead_times(baseline_scores: DataFrame, model_scores: DataFrame, key: str, ahead: str, leads: Sequence[float], replicates: int = 200) -> DataFrame:
    """Per lead: mean and deviation of auprc over replicates for the baseline and the model, and the model's gain in percent.

    Positive rows count only if their event is at least the lead away (``ahead``, null for negatives, which all count).
    """

    def one(lead: float) -> DataFrame:
        parts = []
        for name, scores in (("baseline", baseline_scores), ("model", model_scores)):
            rows = scores.where(F.col(ahead).isNull() | (F.col(ahead) >= lead))
            parts.append(evaluated(rows, key, replicates).agg(F.avg("auprc").alias(f"{name}_mean"), F.stddev_pop("auprc").alias(f"{name}_sd")))
        gain = 100 * (F.col("model_mean") - F.col("baseline_mean")) / F.nullif(F.col("baseline_mean"), F.lit(0.0))
        return parts[0].crossJoin(parts[1]).select(F.lit(lead).alias("lead"), "*", gain.alias("gain_percent"))  # one row each

    found = side_by_side(baseline_scores.sparkSession, [lambda lead=lead: one(lead) for lead in leads])
    for other in found[1:]:
        found[0] = found[0].union(other)
    return found[0]


def tuned(train: DataFrame, features: Sequence[str], folds: Sequence[str], grid: Sequence[dict], label: str = "label") -> DataFrame:
    """Mean average precision over folds (cv_split) of each setting, best first."""
    spark = train.sparkSession
    rows = []
    for k, setting in enumerate(grid):
        found = []
        for fold in folds:
            model = boosted(train.where(F.col("cv_split") != fold), features, label, **setting)
            test = scored(model, train.where(F.col("cv_split") == fold)).select(F.col(label).alias("y"), "score", F.col("label_id"))
            found.append(areas(curve(test)).first()["average_precision"] or 0.0)
        rows.append((k, str(sorted(setting.items())), float(sum(found) / len(found))))
    return spark.createDataFrame(rows, "setting int, parameters string, average_precision double").orderBy(F.desc("average_precision"))


def contributions(model: PipelineModel, df: DataFrame, features: Sequence[str], means: dict[str, float]) -> DataFrame:
    """Add contribution_{feature}: the change of the score when the feature alone has its mean instead.

    One transform a feature, all in the JVM; a plain stand-in for tree path attributions.
    """
    kept = df.columns
    out = scored(model, df)
    for feature in features:
        flat = scored(model, out.withColumnRenamed("score", "_score").withColumn("_own", F.col(feature)).withColumn(feature, F.lit(means[feature])))
        out = flat.withColumn(feature, F.col("_own")).withColumn(f"contribution_{feature}", F.col("_score") - F.col("score"))
        out = out.drop("score", "_own").withColumnRenamed("_score", "score")
    return out.select(*kept, "score", *[f"contribution_{f}" for f in features])


def top_features(contributed: DataFrame, features: Sequence[str], k: int = 10) -> DataFrame:
    """The k features of largest mean absolute contribution."""
    named = [F.struct(F.lit(f).alias("feature"), F.abs(F.col(f"contribution_{f}")).alias("v")) for f in features]
    rows = contributed.select(F.explode(F.array(*named)).alias("x"))
    return rows.groupBy("x.feature").agg(F.avg("x.v").alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature").limit(k)
