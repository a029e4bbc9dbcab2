"""Texts that are one long run of what a pattern repeats: names in a row, numbers of many groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.llm import decontam

MANY = 20_000


def test_tokens_of_long_runs(spark):
    """Neither names in a row nor groups of digits take stack by their number."""
    rows = [(0, " ".join(["Xa"] * MANY)), (1, ",".join(["12"] * MANY)), (2, "Ab Cd ef 1,2.3, Gh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["t"], x["w"]) for x in docs.select("doc_id", decontam.tokens(F.col("text")).alias("t"), decontam.own_words(F.col("text")).alias("w")).collect()}
    assert got[0] == (["\u0001" + rows[0][1]], ["xa"] * MANY)
    assert got[1] == ([rows[1][1]], [rows[1][1]])
    assert got[2] == (["\u0001Ab Cd", "ef", "1,2.3", "\u0001Gh"], ["ab", "cd", "ef", "1,2.3", "gh"])


def test_items_in_long_runs_are_found(spark):
    item = "how many red apples lie in the large green basket of the farmer today"
    run = " ".join(["Xa"] * MANY) + " " + ",".join(["12"] * MANY)
    docs = spark.createDataFrame([(0, f"{run} {item} {run}"), (1, run)], "doc_id long, text string")
    found = decontam.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {x["doc_id"]: (x["contaminated"], x["item_id"]) for x in found.collect()} == {0: (True, 7), 1: (False, None)}
