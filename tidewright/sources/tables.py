"""Reading tracks, cases and tables, and writing results."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BuildConfig

#: How exported track files write a missing number.
MISSING = "-nan(ind)"

CASES = T.StructType(
    [T.StructField("caseid", T.IntegerType()), T.StructField("age", T.IntegerType()), T.StructField("caseend", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("opname", "optype")]
    + [T.StructField("emop", T.IntegerType()), T.StructField("intraop_ebl", T.FloatType())]
    + [T.StructField("bmi", T.FloatType()), T.StructField("asa", T.IntegerType())]
    + [T.StructField("preop_cr", T.FloatType()), T.StructField("preop_htn", T.IntegerType())]
)
TRACKS = "caseid int, tname string, tid string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, one file or a folder of files; only the columns used are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case metadata from CSV; columns are found by name, missing ones are null."""
    header = spark.read.csv(path, header=True)
    return header.select(*[(F.col(f.name) if f.name in header.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CASES])


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=TRACKS)


def read_track_values(spark: SparkSession, path: str, column: str, caseid: int | None = None) -> DataFrame:
    """(caseid, t, column) from CSV files with a time and a value column.

    Missing marks and NaN become null. Without a caseid it is the number before the file's suffix.
    """
    raw = spark.read.csv(path, header=True, nullValue=MISSING, schema="t double, v double")
    case = F.lit(caseid) if caseid is not None else F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.[^/]*$", 1)
    return raw.select(case.cast("int").alias("caseid"), "t", F.nanvl("v", F.lit(None).cast("double")).alias(column))


def no_nan(df: DataFrame) -> DataFrame:
    """NaN of any float column as null, once, at the boundary."""
    kinds = {c for c, k in df.dtypes if k in ("float", "double")}
    return df.select(*[(F.when(~F.isnan(c), F.col(c)).alias(c) if c in kinds else F.col(c)) for c in df.columns])


def write_by_case(df: DataFrame, path: str, buckets: int = 0) -> None:
    """Parquet by case: folders a case, or with buckets a column ``bucket`` of hashed cases that bounds the folders."""
    if buckets:
        df.withColumn("bucket", F.pmod(F.xxhash64("caseid"), F.lit(buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(path)
    else:
        df.repartition("caseid").write.partitionBy("caseid").parquet(path)


def cases_matching(spark: SparkSession, path: str, pattern: str = "caseid=*") -> DataFrame:
    """The folders of cases whose names match a pattern, as one table with caseid."""
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/{pattern}")


def one_case(spark: SparkSession, path: str, caseid: int) -> DataFrame:
    """A point read; folders of other cases are not opened."""
    return spark.read.parquet(path).where(F.col("caseid") == caseid)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_results(df: DataFrame, path: str) -> None:
    """Results of an evaluation as Parquet, over earlier ones; read_results() reads them, so a run need not be repeated."""
    df.write.mode("overwrite").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def built(folder: str, config: BuildConfig) -> bool:
    """Whether a folder was built with this configuration; a folder without parameters counts as not built."""
    at = Path(folder) / "parameters.json"
    return at.exists() and BuildConfig.from_json(at.read_text()) == config


def mark_built(folder: str, config: BuildConfig) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "parameters.json").write_text(config.to_json())


def read_parameters(folder: str) -> dict:
    return json.loads((Path(folder) / "parameters.json").read_text())


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the folder that driver and executors share (spark.checkpoint.dir) and read again.

    Later passes read the same rows in the same parts, also after an executor was lost. A local session without such a folder
    gets a temporary one; a cluster has to name it.
    """
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidewright-")
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def digest(df: DataFrame) -> str:
    """A digest of a table's columns, types and rows that doesn't depend on their order or parts; repeated rows count.

    One pass: the number of rows and the sums of two hashes of each row, in which null has a mark of its own. Maps can't be
    hashed.
    """
    fields = sorted(zip(df.columns, [t for _, t in df.dtypes]))
    marked = [x for c, _ in fields for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    sums = [F.sum(F.xxhash64(F.lit(seed), *marked).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return hashlib.sha256(json.dumps([fields, row["n"], str(row["s1"]), str(row["s2"])]).encode()).hexdigest()


def digest_saved_model(spark: SparkSession, path: str) -> str:
    """A digest of a saved pipeline, or member of an ensemble: its stages' settings and fitted tables, not their names or times."""
    def of(folder: str) -> object:
        about = json.loads(spark.read.text(f"{folder}/metadata").first()[0])
        if "stageUids" in about["paramMap"]:
            return [of(f"{folder}/stages/{_stage_folder(k, uid, len(about['paramMap']['stageUids']))}") for k, uid in enumerate(about["paramMap"]["stageUids"])]
        settings = [about["class"], about["paramMap"], about.get("defaultParamMap", {})]  # defaults hold the stage's name
        found = {"settings": json.dumps(settings, sort_keys=True).replace(about["uid"], "")}
        for name in ("data", "treesMetadata"):
            try:
                rows = spark.read.parquet(f"{folder}/{name}")
            except AnalysisException:  # stages without fitted tables
                continue
            rows = rows.select(*[F.to_json(F.struct(c)).alias(c) if name == "data" else F.regexp_replace(F.col(c).cast("string"), r'"(uid|timestamp)":[^,}]*', "").alias(c) for c in rows.columns])
            found[name] = digest(rows)
        return found

    return hashlib.sha256(json.dumps(of(path.rstrip("/")), sort_keys=True).encode()).hexdigest()


def _stage_folder(k: int, uid: str, stages: int) -> str:
    """How saved pipelines name their stages."""
    return f"{k:0{len(str(stages))}d}_{uid}"


def current_results(
    spark: SparkSession, path: str, make: Callable[[], DataFrame], inputs: Mapping[str, DataFrame],
    models: Mapping[str, str] | None = None, parameters: Mapping[str, object] | None = None, force: bool = False,
) -> DataFrame:
    """The results kept in ``path`` for these input rows, saved models (name to folder) and parameters, or what make() gives, kept.

    Results are kept by a digest of all three, so a changed row, model or parameter makes a new run and going back to earlier
    ones doesn't. They count as kept once a mark is written behind them; what a broken run left is written over.
    """
    state = {
        "inputs": {k: digest(v) for k, v in inputs.items()},
        "models": {k: digest_saved_model(spark, v) for k, v in (models or {}).items()},
        "parameters": parameters or {},
    }
    text = json.dumps(state, sort_keys=True, default=str)
    at = f"{path.rstrip('/')}/{hashlib.sha256(text.encode()).hexdigest()}"
    if force or not _marked(spark, f"{at}/mark"):
        write_results(make(), f"{at}/rows")
        spark.createDataFrame([(text,)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{at}/mark")
    return read_results(spark, f"{at}/rows")


def _marked(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.schema("state string").parquet(path).first() is not None
    except AnalysisException:
        return False
