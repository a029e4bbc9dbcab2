"""Quality rules by line frequency across documents, with word statistics of each text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, key_text, n_words, small, written

SPACE = r"[\x20\x09-\x0D]+"

#: A line is common if it is in at least MIN_DOCS documents of its host, whatever the host's size.
MIN_DOCS = 20
#: A document is depleted if common lines hold more than this percentage of its words.
DEPLETED = 70


def n_repeat_words(text: Column, hashed: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    Windows are hashed and packed with their places into longs, sorted, and compared with their neighbours; windows of one
    hash are compared in full. Should two of one hash differ, the text's windows are put in order by themselves instead.
    """
    one_blank = F.trim(F.regexp_replace(text, SPACE, " "))
    windows = F.regexp_extract_all(one_blank, F.lit("(?<![^ ])(?=([^ ]+ [^ ]+ [^ ]+))"), F.lit(1))
    sure = lambda x: F.coalesce(x, F.lit(False))

    def covered(w: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(w))).cast("int"))
        packed = F.sort_array(F.transform(w, lambda x, k: hashed(x).cast("long").bitwiseAND(-step).bitwiseOR(k.cast("long"))))

        def window(x: Column) -> Column:
            return F.get(w, x.bitwiseAND(step - 1).cast("int"))

        def repeats(p: Column) -> Column:
            same = lambda x, other: sure(x.bitwiseXOR(other).bitwiseAND(-step) == 0)
            clashes = F.filter(p, lambda x, k: F.when(same(x, F.get(p, k - 1)), window(x) != window(F.get(p, k - 1))).otherwise(False))
            found = F.filter(p, lambda x, k: same(x, F.get(p, k - 1)) | same(x, F.get(p, k + 1)))
            return F.when(F.size(clashes) == 0, F.transform(found, lambda x: x.bitwiseAND(step - 1))).otherwise(in_full())

        def in_full() -> Column:
            ordered = F.sort_array(F.transform(w, lambda x, k: F.struct(x.alias("x"), k.cast("long").alias("k"))))
            twice = lambda p: F.filter(p, lambda x, k: sure(x["x"] == F.get(p, k - 1)["x"]) | sure(x["x"] == F.get(p, k + 1)["x"]))
            return F.transform(F.get(F.transform(F.array(ordered), twice), F.lit(0)), lambda x: x["k"])

        places = F.sort_array(F.get(F.transform(F.array(packed), repeats), F.lit(0)))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
        total = F.aggregate(places, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")))
        return total["n"]

    return F.coalesce(F.get(F.transform(F.array(windows), covered), F.lit(0)), F.lit(0).cast("long"))


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; null has none of each."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": n_words(text),
        "word_chars": F.coalesce(F.length(F.regexp_replace(text, SPACE, "")), F.lit(0)).cast("long"),
        "n_symbols": F.coalesce(F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")), F.lit(0)).cast("long"),
        "n_dup_lines": F.coalesce(F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)), F.lit(0)).cast("long"),
        "n_repeat_words": n_repeat_words(text),
    }


def normalised_lines(text: Column) -> Column:
    """Hash and words of each line with a word: lower-cased, digit runs as one 0, white space as one blank."""
    lines = F.filter(F.split(F.lower(F.regexp_replace(text, r"\d+", "0")), "\n"), lambda x: x.rlike(WORD))
    tidy = lambda x: F.trim(F.regexp_replace(x, SPACE, " "))
    return F.transform(lines, lambda x: F.struct(F.xxhash64(tidy(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")))


def apply_rules(
    docs: DataFrame,
    host: str = "source",
    min_docs: int = MIN_DOCS,
    depleted: int = DEPLETED,
) -> DataFrame:
    """Per row of docs (doc_id, text, host): the base columns, base_failed, n_common_words and kept.

    A line is common in a host when at least ``min_docs`` of its documents have it, in hosts of every size. Documents
    are counted as different texts, so a document isn't held against its exact copies; near copies count each. Common
    lines are taken out; a document that loses more than ``depleted`` percent of its words is rejected, as is one with
    base_failed: fewer than 50 words, or more than half of them in repeated windows.

    Null and empty texts have no lines and fail the base rules. Null hosts are one host. Repeated rows give repeated
    rows; an empty table an empty result; other columns are left out. A host or line of any frequency is counted in
    partial sums; rows are joined to the common lines, broadcast only if counted small.
    """
    text = F.col("text")
    kept = docs.select("doc_id", key_text(F.col(host)).alias("host"), F.md5(F.coalesce(text, F.lit(""))).alias("same_text"), normalised_lines(text).alias("lines"), *[v.alias(k) for k, v in base_columns(text).items()])
    kept = kept.withColumn("lines", F.coalesce("lines", F.array().cast("array<struct<h:bigint,w:int>>")))
    kept = written(kept, "line-features")
    texts = written(kept.select("host", "same_text", "lines").dropDuplicates(["host", "same_text"]), "line-texts")

    seen = texts.select("host", F.explode(F.array_distinct("lines.h")).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    common = small(written(seen.where(F.col("n") >= min_docs).select("host", "h"), "common-lines"))

    lines = texts.select("host", "same_text", F.explode("lines").alias("line")).select("host", "same_text", "line.h", "line.w")
    lost = lines.join(common, ["host", "h"]).groupBy("host", "same_text").agg(F.sum("w").alias("n_common_words"))
    found = kept.drop("lines").join(lost, ["host", "same_text"], "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_words",
        (~F.col("base_failed") & (100 * F.col("n_common_words") <= depleted * F.col("n_words"))).alias("kept"),
    )
