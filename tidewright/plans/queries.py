"""The registered queries over the test tables. Floats are rounded, so engines agree on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import series as fx
from ..operators import attribution, bootstrap, cohort, drift, events, metrics, ml, parzen, preprocess, replicates, resample, segments, splits, stats
from ..operators.quantiles import percentiles
from ..sources.tables import staged, table
from .build import STAND_IN, gridded, labelled, segmented, series

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TYPES = ("view", "signup", "click", "error", "purchase")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r(c: str | Column, digits: int = 7, name: str | None = None) -> Column:
    """Rounded, without a negative zero."""
    return (F.round(c, digits) + F.lit(0.0)).alias(name or str(c))


def _features() -> list[Column]:
    """Trend features; residual deviations near zero are noise beyond four digits."""
    return [r(c, 4 if "_std_" in c else 7) for c in STAND_IN.feature_names()]


def _no(c: str) -> Column:
    """A number that may be missing, -1 where it is."""
    return F.coalesce(c, F.lit(-1)).alias(c)


def _grid(spark: SparkSession, folder: str, how: str = "last") -> DataFrame:
    return resample.resample(series(spark, folder), STAND_IN.step, ["mbp"], how, tie="event_id")


def _trimmed(spark: SparkSession, folder: str) -> DataFrame:
    return preprocess.trim_edges(preprocess.mask_range(_grid(spark, folder), "mbp", STAND_IN.low, STAND_IN.high), "mbp")


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """y, score and label_id of events: errors are positive, a user's errors are one event."""
    rows = table(spark, folder, "events")
    return rows.select(
        "event_id", (F.col("event_type") == "error").cast("int").alias("y"), (F.floor("value") / 500.0).alias("score"), F.col("user_id").alias("label_id")
    )


# Resampling


@query
def bucket_first_nonnull(spark: SparkSession, folder: str) -> DataFrame:
    rows = series(spark, folder).withColumn("t", F.col("t") / 3600.0)
    wide = resample.tracks_to_wide(rows.withColumn("_e", F.col("event_id")), ["caseid", "t", "event_id"], "event_type", "mbp", {x: x for x in TYPES[:2]})
    return resample.bucket_first(wide, TYPES[:2], tie="event_id")


@query
def tracks_long_to_wide(spark: SparkSession, folder: str) -> DataFrame:
    return resample.tracks_to_wide(series(spark, folder), ["caseid", "t", "event_id"], "event_type", "mbp", {x: f"track_{x}" for x in TYPES})


@query
def union_by_name_sparse(spark: SparkSession, folder: str) -> DataFrame:
    rows = series(spark, folder)
    parts = [rows.where(F.col("event_type") == x).select("caseid", "t", F.col("mbp").alias(x)) for x in TYPES[:3]]
    return resample.union_sparse(*parts)


@query
def resample_last(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder)


@query
def resample_median_right(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder, "median").select("caseid", "pos", "t", r("mbp"))


@query
def rolling_before_resample(spark: SparkSession, folder: str) -> DataFrame:
    """The exploration's order: raw rows are smoothed, then laid on the grid."""
    rows = series(spark, folder).withColumn("_order", F.struct("t", "event_id"))
    smooth = preprocess.rolling_mean(rows, ["mbp"], STAND_IN.smooth_rows, pos="_order")
    return resample.resample(smooth, STAND_IN.step, ["mbp"], tie="event_id").select("caseid", "pos", "t", r("mbp"))


@query
def first_of_each_name(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("c_nationkey"), "c_mktsegment")
    return resample.first_of_each_name(rows)


@query
def stride_decimate(spark: SparkSession, folder: str) -> DataFrame:
    return resample.decimate(_grid(spark, folder), 5)


@query
def time_slice(spark: SparkSession, folder: str) -> DataFrame:
    return resample.time_slice(series(spark, folder), 86_400, 864_000).select("caseid", "t", "event_id", "mbp")


# Preprocessing


@query
def mask_range(spark: SparkSession, folder: str) -> DataFrame:
    return preprocess.mask_range(series(spark, folder), "mbp", STAND_IN.low, STAND_IN.high).select("event_id", "mbp")


@query
def trim_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _trimmed(spark, folder)


@query
def rolling_mean(spark: SparkSession, folder: str) -> DataFrame:
    return preprocess.rolling_mean(_trimmed(spark, folder), ["mbp"], STAND_IN.smooth_rows).select("caseid", "pos", r("mbp"))


@query
def interpolate_linear(spark: SparkSession, folder: str) -> DataFrame:
    return preprocess.interpolate(_trimmed(spark, folder), ["mbp"]).select("caseid", "pos", r("mbp"))


@query
def fill_zero(spark: SparkSession, folder: str) -> DataFrame:
    return preprocess.fill(_grid(spark, folder), ["mbp"])


@query
def preprocess_chain(spark: SparkSession, folder: str) -> DataFrame:
    return gridded(spark, folder).select("caseid", "pos", "t", r("mbp"))


@query
def peak_reject_centered(spark: SparkSession, folder: str) -> DataFrame:
    return preprocess.reject_peaks(_trimmed(spark, folder), "mbp", 2, 40.0).select("caseid", "pos", "mbp")


@query
def ewm_mean_std(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.ewm(_trimmed(spark, folder), "mbp", 4.0, 16)
    return found.select("caseid", "pos", r("mbp_ewm_mean"), r("mbp_ewm_std"))


# Events


@query
def label_raw(spark: SparkSession, folder: str) -> DataFrame:
    return events.low_runs(gridded(spark, folder), "mbp", STAND_IN.threshold, STAND_IN.n).select("caseid", "pos", "low_run")


@query
def label_dilated(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(spark, folder).select("caseid", "pos", "label")


@query
def event_ids(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(spark, folder).select("caseid", "pos", _no("event_no"), "label_id")


@query
def event_summary(spark: SparkSession, folder: str) -> DataFrame:
    return events.event_summary(labelled(spark, folder), "mbp").select("caseid", "event_no", "begins", "ends", "n_rows", r("lowest"))


# Segments


@query
def segment_windows(spark: SparkSession, folder: str) -> DataFrame:
    return segments.windows(gridded(spark, folder), STAND_IN).where("is_start").select("caseid", "pos", "t")


@query
def segment_validity(spark: SparkSession, folder: str) -> DataFrame:
    rows = segments.windows(segments.validity(labelled(spark, folder), STAND_IN), STAND_IN).where("is_start")
    return rows.select("caseid", "pos", "in_bounds", "no_event_before", "recovered", "enough_data")


@query
def segment_validity_unfilled(spark: SparkSession, folder: str) -> DataFrame:
    rows = _trimmed(spark, folder).withColumn("label", F.lit(0))
    rows = segments.windows(segments.validity(rows, STAND_IN), STAND_IN).where("is_start")
    return rows.select("caseid", "pos", "in_bounds", "enough_data")


@query
def segment_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = segments.windows(segments.outcomes(labelled(spark, folder), STAND_IN), STAND_IN).where("is_start")
    return rows.select("caseid", "pos", "seg_label")


@query
def time_before_event(spark: SparkSession, folder: str) -> DataFrame:
    rows = segments.windows(segments.outcomes(labelled(spark, folder), STAND_IN), STAND_IN).where("is_start and seg_label = 1")
    return rows.select("caseid", "pos", "time", "time_before_event", "seg_event_no")


@query
def ols_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = segments.windows(segments.trends(gridded(spark, folder), STAND_IN), STAND_IN).where("is_start")
    return rows.select("caseid", "pos", *_features())


@query
def last_value(spark: SparkSession, folder: str) -> DataFrame:
    rows = segments.windows(gridded(spark, folder), STAND_IN)
    last = F.lead("mbp", STAND_IN.obs - 1).over(fx.over())
    return rows.withColumn("last_map_value", last).where("is_start").select("caseid", "pos", r("last_map_value"))


@query
def raw_signal_flatten(spark: SparkSession, folder: str) -> DataFrame:
    rows = segmented(spark, folder, raw=True)
    return rows.select("caseid", "time", "label", *[r(f"mbp_{k}") for k in range(STAND_IN.obs)])


@query
def segments_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = segmented(spark, folder)
    return rows.select("caseid", "time", "label", _no("time_before_event"), _no("event_no"), r("last_map_value"), *_features())


@query
def lead_time_filter(spark: SparkSession, folder: str) -> DataFrame:
    return segments.lead_time_filter(segmented(spark, folder), 64_800).select("caseid", "time", "label", _no("time_before_event"))


@query
def single_case(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(spark, folder).where("caseid = 3").select("caseid", "pos", "t", r("mbp"), "label", _no("event_no"))


# Cohorts and joins


@query
def cohort_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The cohort rule on orders and customers: age, caseend, names, emop and a loss that may be unknown stand in."""
    cases = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cases = cases.select(
        F.col("o_orderkey").alias("caseid"),
        (F.col("o_custkey") % 90).alias("age"),
        F.col("o_totalprice").alias("caseend"),
        F.col("o_orderpriority").alias("optype"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Liver Transplant").otherwise(F.col("c_mktsegment")).alias("opname"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("emop"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10).alias("intraop_ebl"),
    )
    return cohort.eligible(cases).select("caseid", "opname", "age")


@query
def semi_join_cases(spark: SparkSession, folder: str) -> DataFrame:
    rich = table(spark, folder, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("caseid"))
    return cohort.only(series(spark, folder), rich).select("event_id", "caseid")


@query
def anti_join_cases(spark: SparkSession, folder: str) -> DataFrame:
    rich = table(spark, folder, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("caseid"))
    return cohort.without(series(spark, folder), rich).select("event_id", "caseid")


@query
def join_segments_static(spark: SparkSession, folder: str) -> DataFrame:
    static = table(spark, folder, "customer").select(F.col("c_custkey").alias("caseid"), "c_mktsegment", "c_acctbal")
    return segmented(spark, folder).join(static, "caseid").select("caseid", "time", "label", "c_mktsegment", "c_acctbal")


@query
def key_sets_agree(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("caseid"))
    return cohort.same_keys(series(spark, folder), customers)


@query
def null_count_filter(spark: SparkSession, folder: str) -> DataFrame:
    wide = resample.tracks_to_wide(series(spark, folder), ["caseid", "event_id"], "event_type", "mbp", {x: x for x in TYPES})
    per_case = wide.groupBy("caseid").agg(*[F.max(x).alias(x) for x in TYPES])
    return per_case.dropna(how="any", subset=list(TYPES[:3]))


@query
def in_list_and_prefix(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").where(F.col("p_type").isin("ECONOMY", "SMALL") & cohort.lacks("p_name", "RING"))
    return parts.select("p_partkey", F.split("p_name", " ")[0].alias("first_word"), F.concat_ws("_", "p_partkey", "p_size").alias("name_id"))


# Splits


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    return splits.case_stats(segmented(spark, folder))


def _kept(df: DataFrame) -> DataFrame:
    """df, which is passed over several times: written once where the session names a checkpoint folder."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


@query
def case_label_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _stats(spark, folder)


@query
def split_70_30(spark: SparkSession, folder: str) -> DataFrame:
    return splits.ordered_split(_stats(spark, folder)).select("caseid", "split")


@query
def split_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    return splits.ordered_split(_stats(spark, folder), order=splits.hash_order(42)).select("caseid", "split")


@query
def split_ratios(spark: SparkSession, folder: str) -> DataFrame:
    found = splits.split_ratios(splits.ordered_split(_stats(spark, folder)))
    return found.select("split", "n_cases", "segments", r("label_ratio"), r("segment_ratio"))


@query
def split_balanced(spark: SparkSession, folder: str) -> DataFrame:
    return splits.balanced_split(_kept(_stats(spark, folder)), seeds=50, tolerances=(1e-9, 1e-9)).select("caseid", "seed", "split")


@query
def cv_folds(spark: SparkSession, folder: str) -> DataFrame:
    parts = splits.ordered_split(_kept(_stats(spark, folder)))
    return splits.folds(parts, 3, splits.hash_order(7)).select("caseid", "split", "cv_split")


@query
def key_batches(spark: SparkSession, folder: str) -> DataFrame:
    return splits.batches(table(spark, folder, "customer").select("c_custkey"), "c_custkey", 100)


@query
def fold_search(spark: SparkSession, folder: str) -> DataFrame:
    train = splits.ordered_split(_kept(_stats(spark, folder))).where("split = 'train'")
    return splits.fold_search(train, 3, 20, crossed=False).select("caseid", "seed", "fold")


# Metrics


@query
def pr_event_curve(spark: SparkSession, folder: str) -> DataFrame:
    points = metrics.curve(_scores(spark, folder))
    return points.select(r("threshold", 6), r("precision", 6), r("event_recall", 6))


@query
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.curve(_scores(spark, folder)).select(r("threshold", 6), r("fpr", 6), r("recall", 6))


def _areas(spark: SparkSession, folder: str, column: str) -> DataFrame:
    return metrics.areas(metrics.curve(_scores(spark, folder))).select(r(column, 6))


@query
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return _areas(spark, folder, "average_precision")


@query
def auroc(spark: SparkSession, folder: str) -> DataFrame:
    return _areas(spark, folder, "auroc")


@query
def auprc_event(spark: SparkSession, folder: str) -> DataFrame:
    return _areas(spark, folder, "auprc")


def _picked(spark: SparkSession, folder: str, strategy: str, value: float = 0.0) -> DataFrame:
    point = metrics.pick(metrics.curve(_scores(spark, folder)), strategy, value)
    return point.select(r("threshold", 6), r("precision", 6), r("event_recall", 6))


@query
def threshold_max_precision(spark: SparkSession, folder: str) -> DataFrame:
    return _picked(spark, folder, "max_precision")


@query
def threshold_target_recall(spark: SparkSession, folder: str) -> DataFrame:
    return _picked(spark, folder, "targeted_recall", 0.5)


@query
def threshold_target_precision(spark: SparkSession, folder: str) -> DataFrame:
    return _picked(spark, folder, "targeted_precision", 0.25)


@query
def threshold_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return _picked(spark, folder, "fixed_threshold", 0.1)


@query
def derived_specificity_npv_f1(spark: SparkSession, folder: str) -> DataFrame:
    point = metrics.derived(metrics.pick(metrics.curve(_scores(spark, folder)), "targeted_recall", 0.5))
    return point.select(*[r(c, 6) for c in ("prevalence", "specificity", "npv", "f1")])


@query
def score_at_baseline_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The curve's point at the event recall that a baseline of customer numbers has at its best precision."""
    rows = _scores(spark, folder)
    base = metrics.pick(metrics.curve(rows.withColumn("score", F.pmod("label_id", F.lit(97)) / 97)), "max_precision")
    recall = base.first()["event_recall"]
    point = metrics.pick(metrics.curve(rows), "targeted_recall", recall)
    return point.select(r(F.lit(recall), 6, "baseline_recall"), r("threshold", 6), r("precision", 6), r("event_recall", 6))


@query
def thresholds_of_curves(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scores(spark, folder)
    parts = [metrics.curve(rows.where(F.pmod("label_id", F.lit(2)) == k)) for k in (0, 1)]
    return metrics.thresholds(*parts).select(r("threshold", 6))


@query
def curve_interp_grid(spark: SparkSession, folder: str) -> DataFrame:
    grid = metrics.on_grid(metrics.curve(_scores(spark, folder)), "fpr", "recall", 101)
    return grid.select("step", r("y", 5, "tpr"))


@query
def ece(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.ece(_scores(spark, folder)).select(r("ece", 6))


@query
def calibration_curve(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.calibration(_scores(spark, folder)).select("bin", r("mean_score", 6), r("positive_share", 6), "n")


@query
def score_to_value(spark: SparkSession, folder: str) -> DataFrame:
    """The raw value whose score is nearest to a threshold, the first row among equals."""
    rows = table(spark, folder, "events").select("event_id", "value", (1 - F.col("value") / 120).alias("score"))
    return rows.agg(F.min_by("value", F.struct(F.abs(F.col("score") - 0.6), "event_id")).alias("value"))


@query
def score_to_value_curve(spark: SparkSession, folder: str) -> DataFrame:
    """For every threshold of a curve the value of the event whose score is nearest, the least event_id among equals."""
    rows = table(spark, folder, "events").select("event_id", "value", (1 - F.floor("value") / 128).alias("score"))
    points = metrics.curve(_scores(spark, folder)).select("threshold")
    return metrics.nearest(points, "threshold", rows, "score", "value", "event_id").select(r("threshold", 6), r("nearest_value", 6))


@query
def curve_thinned(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty points of the curve by their change of precision, and its ends."""
    points = metrics.thinned(metrics.curve(_scores(spark, folder)), 20)
    return points.select(r("threshold", 6), r("precision", 6), r("event_recall", 6), r("above_precision", 6))


@query
def bootstrap_auc(spark: SparkSession, folder: str) -> DataFrame:
    found = bootstrap.bootstrap_areas(bootstrap.exact(_scores(spark, folder), 20, "event_id"))
    return found.select("boot_id", r("average_precision", 6), r("auroc", 6), r("auprc", 6))


@query
def bootstrap_spread(spark: SparkSession, folder: str) -> DataFrame:
    found = bootstrap.spread(bootstrap.bootstrap_areas(bootstrap.exact(_scores(spark, folder), 20, "event_id")), ["auroc"])
    return found.select(*[r(f"auroc_{k}", 5) for k in ("mean", "sd", "median")])


@query
def pr_bands(spark: SparkSession, folder: str) -> DataFrame:
    found = bootstrap.bands(bootstrap.exact(_scores(spark, folder), 20, "event_id"), steps=101)
    return found.select("step", *[r(c, 5) for c in ("mean", "low", "high")])


@query
def bootstrap_poisson(spark: SparkSession, folder: str) -> DataFrame:
    found = bootstrap.bootstrap_areas(bootstrap.poisson(_scores(spark, folder), 20, "event_id"))
    return found.select("boot_id", "average_precision", "auroc", "auprc")


@query
def bootstrap_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All nine metrics of 20 replicates, each at its own point of highest precision."""
    found = replicates.evaluated(_scores(spark, folder), "event_id", 20)
    return found.select("boot_id", *[r(c, 6) for c in replicates.METRICS])


@query
def bootstrap_metrics_at_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, deviation and median over 200 replicates, each at the event recall that is nearest to a half."""
    found = replicates.evaluated(_scores(spark, folder), "event_id", 200, "targeted_recall", 0.5)
    spread = bootstrap.spread(found, list(replicates.METRICS))
    return spread.select(*[r(c, 5) for c in spread.columns])


@query
def lead_time_study(spark: SparkSession, folder: str) -> DataFrame:
    """Area under precision and event recall of low last values, for events at least so far ahead; all negatives stay."""
    rows = segmented(spark, folder).select(
        F.col("label").alias("y"), (1 - F.round("last_map_value", 3) / 120).alias("score"), fx.event_name(F.col("event_no"), F.col("caseid")).alias("label_id"), "time_before_event"
    )
    leads = F.array(*[F.lit(k) for k in (43_200, 64_800, 86_400, 108_000)])
    each = rows.withColumn("lead_seconds", F.explode(leads)).where("time_before_event is null or time_before_event >= lead_seconds")
    return metrics.areas(metrics.curve(each, ["lead_seconds"]), ["lead_seconds"]).select("lead_seconds", r("auprc", 5))


@query
def lead_time_gain(spark: SparkSession, folder: str) -> DataFrame:
    """Per lead the spread of auprc over replicates of two scores of a segment, and the gain of the second."""
    last, trend = 1 - F.floor("last_map_value") / 128, 1 - F.floor(F.col("last_map_value") + F.col("mbp_slope_86400")) / 128
    rows = segmented(spark, folder).select(
        F.concat_ws(":", "caseid", "time").alias("segment"), F.col("label").alias("y"), last.alias("last"), F.coalesce(trend, last).alias("trend"),
        fx.event_name(F.col("event_no"), F.col("caseid")).alias("label_id"), "time_before_event",
    )
    rows = staged(rows, "scores")
    base, model = [rows.withColumnRenamed(c, "score") for c in ("last", "trend")]
    found = ml.lead_times(base, model, "segment", "time_before_event", [43_200, 86_400], 20)
    return found.select(F.col("lead").cast("long").alias("lead"), *[r(c, 4) for c in ("baseline_mean", "baseline_sd", "model_mean", "model_sd", "gain_percent")])


# Statistics


@query
def describe_numeric(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.describe(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"])
    return found.select("l_returnflag", "column", "n", *[r(c) for c in ("mean", "sd", "min", "p25", "p50", "p75", "max")])


@query
def duration_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    start = F.min("t").over(Window.partitionBy("caseid"))
    rows = series(spark, folder).withColumn("t", F.col("t") - start)
    return stats.duration_quantiles(rows).select(*[r(c) for c in ("q1", "median", "q3")])


@query
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.value_counts(table(spark, folder, "orders"), "o_orderpriority")


@query
def histogram_density(spark: SparkSession, folder: str) -> DataFrame:
    return stats.histogram(series(spark, folder), "mbp", 0.0, 150.0, 30).select("bin", "n", r("density", 6))


@query
def shared_bounds(spark: SparkSession, folder: str) -> DataFrame:
    rows = series(spark, folder)
    return stats.shared_bounds(rows.where("event_type = 'error'"), rows.where("event_type = 'click'"), "mbp")


@query
def prevalence_by_split(spark: SparkSession, folder: str) -> DataFrame:
    parts = splits.ordered_split(_stats(spark, folder)).select("caseid", "split")
    found = stats.prevalence(segmented(spark, folder).join(parts, "caseid"), "label", ["split"])
    return found.select("split", "n", "n_positive", r("prevalence"))


@query
def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.null_counts(_grid(spark, folder), ["mbp"])


@query
def mean_sd_or_median_iqr(spark: SparkSession, folder: str) -> DataFrame:
    also = {"m": F.avg("c_acctbal"), "s": F.stddev_samp("c_acctbal")}
    rows = percentiles(table(spark, folder, "customer"), "c_acctbal", stats.QUARTILES, ["c_mktsegment"], also)
    return rows.select("c_mktsegment", r("m", 5, "mean"), r("s", 5, "sd"), *[r(F.col("q")[k], 5, f"q{k + 1}") for k in range(3)])


@query
def gated_summary(spark: SparkSession, folder: str) -> DataFrame:
    return stats.gated_summary(table(spark, folder, "customer"), "c_acctbal", "c_mktsegment").select("c_mktsegment", "summary")


@query
def conditional_shares(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer")
    return rows.agg(F.count_if(F.col("c_acctbal") < 0).alias("n_debt"), r(F.avg((F.col("c_acctbal") < 0).cast("double")), 6, "share_debt"), F.countDistinct("c_nationkey").alias("n_nations"))


@query
def grouped_contributions(spark: SparkSession, folder: str) -> DataFrame:
    groups = {"price": ["l_extendedprice", "l_discount"], "other": ["l_quantity", "l_tax", "l_discount"]}
    rows = table(spark, folder, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    found = stats.grouped_sums(rows, "row_id", groups)
    return found.select("row_id", r("price"), r("other"))


# Drift

SHAPE = ("l_quantity", "l_discount", "l_tax")


def _flag(spark: SparkSession, folder: str, flag: str) -> DataFrame:
    return table(spark, folder, "lineitem").where(F.col("l_returnflag") == flag)


@query
def covariance_matrix(spark: SparkSession, folder: str) -> DataFrame:
    found = drift.covariance(table(spark, folder, "lineitem"), SHAPE)
    return found.select(*[r(c, 6) for c in found.columns])


@query
def mahalanobis_3d(spark: SparkSession, folder: str) -> DataFrame:
    found = drift.mahalanobis(_flag(spark, folder, "R"), SHAPE, _flag(spark, folder, "N"))
    return found.select("l_orderkey", "l_linenumber", "l_quantity", r("distance"))


@query
def ood_fraction_curve(spark: SparkSession, folder: str) -> DataFrame:
    found = drift.exceedance(_flag(spark, folder, "N"), _flag(spark, folder, "R"), list(range(50, 100)), "l_extendedprice")
    return found.select("level", r("limit"), r("share_above", 6))


@query
def confidence_score(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("distance"))
    return drift.confidence(rows, 50_000.0).select("l_orderkey", "l_linenumber", r("confidence"))


@query
def fixed_sample(spark: SparkSession, folder: str) -> DataFrame:
    return drift.fixed_sample(table(spark, folder, "customer"), 50, "c_custkey").select("c_custkey", "c_name")


# Models


def _inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with folds.

    The segments are written before the cases are dealt, and again with their folds: the ranking of cases reads them several
    times, and so do fits and scores.
    """
    rows = staged(segmented(spark, folder).withColumn("label_id", fx.event_name(F.col("event_no"), F.col("caseid"))), "segments")
    parts = splits.folds(splits.ordered_split(splits.case_stats(rows)), 3).select("caseid", "split", "cv_split")
    return staged(rows.dropna(subset=STAND_IN.feature_names()).join(parts, "caseid"), "inputs")


MODEL_FEATURES = [c for c in STAND_IN.feature_names() if not c.endswith("std_43200")]


@query
def baseline_calibrated(spark: SparkSession, folder: str) -> DataFrame:
    rows = _inputs(spark, folder)
    model = ml.baseline(rows.where("split = 'train'").select("label", "last_map_value"))
    return ml.scored(model, rows.where("split = 'test'").select("caseid", "time", "label", "last_map_value"))


@query
def gbt_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = _inputs(spark, folder)
    model = ml.boosted(rows.where("split = 'train'"), MODEL_FEATURES, trees=5)
    return ml.scored(model, rows.where("split = 'test'").select("caseid", "time", "label", *MODEL_FEATURES)).select("caseid", "time", "label", "score")


@query
def model_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _inputs(spark, folder)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    base = ml.scored(ml.baseline(train.select("label", "last_map_value")), test)
    model = ml.scored(ml.boosted(train, MODEL_FEATURES, trees=5), test)
    return ml.evaluation(*[x.select(F.col("label").alias("y"), "score", "label_id") for x in (base, model)])


@query
def calibrated_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of test segments by a baseline whose margins are calibrated out of fold."""
    rows = _inputs(spark, folder)
    train = rows.where("split = 'train'").select(F.concat_ws(":", "caseid", "time").alias("segment"), "label", "last_map_value")
    models = ml.calibrated_by_folds(train, "segment")
    return ml.ensemble_scored(models, rows.where("split = 'test'").select("caseid", "time", "label", "last_map_value"))


@query
def replicated_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Every metric's spread over 200 replicates for the calibrated baseline and the boosted trees."""
    rows = _inputs(spark, folder).withColumn("segment", F.concat_ws(":", "caseid", "time"))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    base = ml.ensemble_scored(ml.calibrated_by_folds(train.select("segment", "label", "last_map_value"), "segment"), test)
    model = ml.scored(ml.boosted(train, MODEL_FEATURES, trees=5), test)
    own, other = [x.select("segment", F.col("label").alias("y"), "score", "label_id", "last_map_value") for x in (base, model)]
    return ml.replicated_evaluation(staged(own, "baseline"), [staged(other, "model")], "segment", signal="last_map_value")


@query
def cv_tune(spark: SparkSession, folder: str) -> DataFrame:
    rows = _inputs(spark, folder).where("split = 'train'").select("label", "label_id", "cv_split", *MODEL_FEATURES)
    return ml.tuned(rows, MODEL_FEATURES, ["cv_0", "cv_1", "cv_2"], [{"trees": 3, "depth": 2}, {"trees": 3, "depth": 3}])


@query
def parzen_tune(spark: SparkSession, folder: str) -> DataFrame:
    """Four trials of small trees over three folds; tuned_trees() has 100 trials of up to 500 trees by default."""
    rows = _inputs(spark, folder).where("split = 'train'").select("label", "label_id", "cv_split", *MODEL_FEATURES)
    space = parzen.TREES | {"trees": parzen.Number(2, 4, whole=True), "depth": parzen.Number(1, 3, whole=True)}
    return parzen.tuned_trees(rows, MODEL_FEATURES, ["cv_0", "cv_1", "cv_2"], 4, space=space)


@query
def top_contributions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _inputs(spark, folder)
    names = MODEL_FEATURES[:4]
    train = rows.where("split = 'train'")
    model = ml.boosted(train, names, trees=5)
    means = train.agg(*[F.avg(c).alias(c) for c in names]).first().asDict()
    found = ml.contributions(model, rows.where("split = 'test'").select("caseid", "time", *names), names, means)
    return ml.top_features(found, names, 3)


def _attributed(spark: SparkSession, folder: str) -> DataFrame:
    rows = _inputs(spark, folder)
    model = ml.boosted(rows.where("split = 'train'"), MODEL_FEATURES, trees=5)
    return attribution.attributed(model, rows.where("split = 'test'").select("caseid", "time", *MODEL_FEATURES), MODEL_FEATURES)


@query
def tree_attributions(spark: SparkSession, folder: str) -> DataFrame:
    """Of each test segment the margin of the boosted trees, and how much each feature moves it from the base."""
    return _attributed(spark, folder).drop(*MODEL_FEATURES)


@query
def top_attributions(spark: SparkSession, folder: str) -> DataFrame:
    return attribution.ranked(_attributed(spark, folder), MODEL_FEATURES, 10)
