"""What the corpus operators share: the shared scratch folder, written tables, and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: A word is a longest run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only when it was written, measured, and has at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20

_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of its own; a cluster has to name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage.

    An executor that is lost later loses nothing: the files are in the shared folder.
    """
    spark = df.sparkSession
    at = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def removed(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more, so that they don't wait on disk for the end."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Carried:
    """A caller's table with its columns but those in ``used`` under names that no operator has, and back again."""

    def __init__(self, df: DataFrame, *used: str | None) -> None:
        self.names = {f"callers_{k}": c for k, c in enumerate(df.columns) if c not in used}
        self.others = {c: name for name, c in self.names.items()}
        self.df = df.select(*[F.col(f"`{c}`").alias(self.others.get(c, c)) for c in df.columns])

    def back(self, result: DataFrame) -> DataFrame:
        """result with the caller's names; of those that the operator has added, its own column stays."""
        made = {c for c in result.columns if c not in self.names}
        kept = [c for c in result.columns if self.names.get(c) not in made]
        return result.select(*[F.col(c).alias(self.names.get(c, c)) for c in kept])


def width(kind: DataType, column: Column) -> Column:
    """Bytes of a value: of its characters, of an array's elements, else eight."""
    if isinstance(kind, StringType | BinaryType):
        return F.octet_length(column)
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        if not isinstance(inner, StringType | BinaryType | ArrayType | StructType):
            return 8 * F.size(column)
        return F.aggregate(column, F.lit(0), lambda sum_, x: sum_ + F.coalesce(width(inner, x), F.lit(0)))
    if isinstance(kind, StructType):
        return sum((F.coalesce(width(f.dataType, column[f.name]), F.lit(0)) for f in kind), F.lit(0))
    return F.lit(8)


def fits(table: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a written table's counted rows and bytes are within the bounds of a broadcast."""
    bytes_ = sum((F.coalesce(width(f.dataType, F.col(f"`{f.name}`")), F.lit(0)) for f in table.schema), F.lit(0))
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(bytes_), F.lit(0))).first()
    return rows <= most and size <= most_bytes


def small(table: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if it fits(); else leave the join to Spark."""
    return F.broadcast(table) if fits(table, most, most_bytes) else table


def n_words(text: Column) -> Column:
    """Number of words as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text, as two longs t1 and t2; null and empty texts have the same."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2")


def key_text(column: Column) -> Column:
    """A key as text, null told apart from every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def lean(df: DataFrame) -> DataFrame:
    """df, about to be read by Python tasks: batches of texts hold BATCH_BYTES at most, or one long text.

    Where the session has Spark's own default of 64 MB, it is lowered; any other setting stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
