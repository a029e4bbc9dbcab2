"""Mixing sources to target weights by Pareto order sampling.

Each document is due m copies, m between 0 and ``most``: the whole part of m is certain, and the fraction is the
inclusion probability p of one more copy. Documents are ranked by their random odds u / (1 - u) divided by the
inclusion odds p / (1 - p); the first of a source are taken until the words that its certain copies leave open are
filled. So sources get a fixed size in words, and documents unequal probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Carried, key_text, n_words, small, written

#: Ranks of a source are counted in so many bins; only the bin that holds the cut is ordered row by row.
BINS = 16_384
#: Steps between the random numbers of rows that are equal in all.
GOLDEN = 0.6180339887498949


def _uniform(doc_id: Column, text: Column) -> Column:
    """A fixed random number in (0, 1) for each doc_id and text: 50 bits of an md5."""
    key = F.concat(key_text(doc_id), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").bitwiseAND((1 << 50) - 1) + 0.5) / float(1 << 50)


_EQUAL = ("source", "doc_id", "_u", "size")


def _repeats(df: DataFrame) -> DataFrame | None:
    """The keys _k0 to _k3 that more than one row has; None without any."""
    rows = df.groupBy(*_EQUAL).agg(F.count("*").alias("rows")).where("rows > 1")
    found = written(rows.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(_EQUAL)]), "mix-repeats")
    return found if found.limit(1).count() else None


def _numbered(df: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """df with _u set apart for rows that are equal in source, doc_id, _u and size: steps of the golden ratio, modulo 1.

    Which of such rows has which number is open, but the numbers don't depend on how rows lie in partitions: equal rows
    are counted a partition, numbered within it, and moved on by the partitions before. Only rows that have equals are
    written and numbered, and no window holds more than a partition's rows of one key.
    """
    if repeats is None:
        return df
    key = list(_EQUAL)
    same = F.lit(True)
    for k, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    few = small(repeats)
    rows = written(df.join(few, same, "left_semi").withColumn("_part", F.spark_partition_id()), "mix-equal-rows")
    parts = rows.groupBy(*key, "_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(key)], F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(F.lit(1)))
    rows = rows.withColumn("_place", place).join(small(written(parts, "mix-parts")), same & (F.col("_part") == F.col("_p")))
    u = F.col("_u") + (F.col("_before") + F.col("_place") - 1) * F.lit(GOLDEN)
    return df.join(few, same, "left_anti").unionByName(rows.withColumn("_u", u - F.floor(u)).select(df.columns))


def _level(size: Column) -> Column:
    """The importance class of a size: its number of binary digits, at most 64 classes."""
    return F.length(F.bin(size)).cast("int")


def _importance(level: Column) -> Column:
    """Longer documents are somewhat likelier to be in: 1.1 for a word, 2 for 500 words, 2.5 for 20,000."""
    return F.lit(1.0) + level / 10.0


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Words due to each source, from a table (source, source_size) with a row a source.

    Sources in order of code point, null last, have the weights in turn. They share ``share`` times all words by
    weight; a target stops at ``most`` times its source's size, and the excess goes to the others by weight.
    """
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = most * F.col("source_size")
    by_need = Window.orderBy(cap / F.col("weight"), "place")
    seen, rest = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(seen), F.lit(0.0))) / F.sum("weight").over(rest)
    full = ranked.withColumns({"cap": cap, "level": level}).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    shared = F.col("weight") * left / F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    return full.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(shared).alias("target"))


def _plan(levels: DataFrame, due: DataFrame, most: float) -> DataFrame:
    """Copies m due at each (source, level): importance times a factor that meets the target, at most ``most``."""
    q, s = _importance(F.col("level")), F.col("level_size")
    high = Window.partitionBy("source").orderBy(F.col("level").desc())
    seen, rest = high.rowsBetween(Window.unboundedPreceding, -1), high.rowsBetween(0, Window.unboundedFollowing)
    factor = (F.col("target") - most * F.coalesce(F.sum(s).over(seen), F.lit(0))) / F.nullif(F.sum(q * s).over(rest), F.lit(0.0))
    full = levels.join(due, levels["source"].eqNullSafe(due["source"])).drop(due["source"]).withColumns({"factor": factor}).withColumn(
        "full", (F.col("target") >= most * F.col("source_size")) | (F.col("factor") * q >= most)
    )
    one = Window.partitionBy("source")
    left = F.col("target") - most * F.coalesce(F.sum(F.when(F.col("full"), s)).over(one), F.lit(0))
    factor = left / F.nullif(F.sum(F.when(~F.col("full"), q * s)).over(one), F.lit(0.0))
    copies = F.when(F.col("full"), F.lit(float(most))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.coalesce(factor, F.lit(0.0)) * q)))
    return full.select("source", "level", "level_size", "source_size", "target", copies.alias("due_copies"))


def _draw(df: DataFrame) -> DataFrame:
    """From due_copies and _u: whole copies, and the rank of one more (null where there is no fraction)."""
    p = F.col("due_copies") - F.floor("due_copies")
    odds = (F.col("_u") / (1 - F.col("_u"))) / (p / F.nullif(1 - p, F.lit(0.0)))
    return df.withColumn("whole", F.floor("due_copies").cast("long")).withColumn("rank", F.when(p > 0, odds))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of docs (all by default) and size, source_size, target, copies and taken.

    docs has doc_id, text and source. size is the number of words of the text (null: 0), taken is copies * size. Each
    source's taken words differ from its target by no more than half the size of the document at the cut. A row's random
    number comes from its doc_id and text, and rows that are equal in both have spread numbers, so null and repeated ids
    are drawn as others are, and reruns agree (of equal rows with other columns that differ, any may be the one that is
    taken). There are no ties but of rows without words, which are never drawn: they have their certain copies only.
    Sources may be null, texts empty, null or of any length. An empty table gives an empty result. Columns with names of
    the added ones are replaced.

    No row is moved by source: a source's ranks are summed in BINS bins, then only the bin with the cut is put in
    order, and the cut is joined to the documents. Tables by source are broadcast if measured small.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    carried = Carried(docs, "doc_id", "text", "source")
    base = carried.df
    keep = [c for c in base.columns if carried.names.get(c) not in added and (keep is None or carried.names.get(c, c) in keep)]
    slim_only = "text" not in keep and set(keep) <= {"doc_id", "source"}
    kept = [c for c in dict.fromkeys([*keep, "doc_id", "source"]) if c != "_u"]
    sized = base.select(*kept, n_words(F.col("text")).alias("size"), _uniform(F.col("doc_id"), F.col("text")).alias("_u"))
    slim = written(sized.select("doc_id", "source", "size", "_u"), "mix-sizes")
    repeats = _repeats(slim)
    slim = slim if repeats is None else written(_numbered(slim, repeats), "mix-numbered")
    sized = slim if slim_only else _numbered(sized, repeats)

    levels = written(slim.groupBy("source", _level(F.col("size")).alias("level")).agg(F.sum("size").alias("level_size")), "mix-levels")
    due = targets(levels.groupBy("source").agg(F.sum("level_size").alias("source_size")), weights, share, most)
    plan = written(_plan(levels, due, most), "mix-plan")
    certain = plan.groupBy("source").agg((F.max("target") - F.sum(F.floor("due_copies") * F.col("level_size"))).alias("open"))

    def drawn(df: DataFrame) -> DataFrame:
        x = small(plan.select(F.col("source").alias("_source"), F.col("level").alias("_level"), "source_size", "target", "due_copies"))
        df = df.withColumn("_size_level", _level(F.col("size")))
        joined = df.join(x, df["source"].eqNullSafe(x["_source"]) & (F.col("_size_level") == F.col("_level")), "left")
        return _draw(joined.drop("_source", "_level", "_size_level"))

    ranked = drawn(slim).where(F.col("rank").isNotNull() & (F.col("size") > 0)).withColumn(
        "bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int")
    )
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    run = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("before", F.sum("bin_size").over(run) - F.col("bin_size"))
    bins = bins.join(small(written(certain, "mix-open")).withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    # The last bin that begins below the open words holds the cut; those before it are in, those after it out.
    cut = written(
        bins.where(F.col("before") < F.col("open")).groupBy("source").agg(F.max(F.struct("bin", "before", "open")).alias("c")).select(
            F.col("source").alias("_source"), "c.bin", F.col("c.before").alias("before"), "c.open"
        ),
        "mix-cut",
    )
    c = small(cut)
    inside = ranked.join(c, ranked["source"].eqNullSafe(c["_source"]) & (ranked["bin"] == c["bin"]))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size")  # one bin of a source
    up_to = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("up_to", up_to).where(2 * F.col("up_to") - F.col("size") <= 2 * F.col("open")).groupBy("source").agg(
        F.max(F.struct("rank", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id"), "size")).alias("last")
    )
    ends = written(
        cut.join(last, F.col("_source").eqNullSafe(F.col("source")), "left").select("_source", F.col("bin").alias("_bin"), "last"), "mix-ends"
    )
    result = drawn(sized)
    bin_ = F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int")
    result = result.join(small(ends), F.col("source").eqNullSafe(F.col("_source")), "left")
    chosen = (F.col("size") > 0) & (
        (bin_ < F.col("_bin"))
        | ((bin_ == F.col("_bin")) & (F.struct("rank", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id"), "size") <= F.col("last")))
    )
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
    result = result.withColumn("copies", copies.cast("long"))
    return carried.back(result.select(*keep, *added[:4], (F.col("copies") * F.col("size")).alias("taken")))


def repeat(mixed: DataFrame) -> DataFrame:
    """One row for each copy of mix(), with its number from 1 as copy, which replaces a column of that name.

    Rows without a copy, as null and empty texts are, give none; equal rows are repeated each; an empty table stays empty.
    """
    return mixed.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
