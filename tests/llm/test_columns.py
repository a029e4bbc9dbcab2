"""The caller's columns come back unchanged, whatever their names, from every operator that keeps them."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, labels

from tidewright import llm
from tidewright.llm import decontam, mixing, neardup, ngramquality, sharding, urlfilter

ADDED = {
    "mix": {"size", "source_size", "target", "copies", "taken"}, "repeat": {"size", "source_size", "target", "copies", "taken", "copy"},
    "judge": {"host", "path", "rule", "verdict"}, "place": {"slot", "shard"}, "clean": set(), "trusted_like": set(), "one_of_each": set(),
}


def internal_names():
    """Every word that the modules of the library have in quotes as a name, and the names that stand in for columns."""
    text = "".join((Path(llm.__file__).parent / f"{m}.py").read_text() for m in ("mixing", "urlfilter", "sharding", "decontam", "ngramquality", "neardup"))
    names = {x for x in re.findall(r"\"(_?[a-z][a-z0-9_]*)\"", text)} | {"callers_0", "callers_7", "a.b", "of a b"}
    return sorted(names - {"doc_id", "text", "source", "lang"})


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["one two three four five six", "one two three four five six", "x y z", None, "", "alpha beta gamma delta epsilon zeta eta theta"]
    made = spark.createDataFrame([(k, t, "en", "ab"[k % 2], k) for k, t in enumerate(texts)], DOCS)
    return made.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in internal_names()})


@pytest.mark.parametrize("name", sorted(ADDED))
def test_columns_come_back(spark, rows, name):
    bench = spark.createDataFrame([("q1", "alpha beta gamma delta epsilon zeta eta theta")], "item_id string, text string")
    rules = urlfilter.rule_table(spark, [("block", "net", "/")])
    found = {
        "mix": lambda: mixing.mix(rows), "repeat": lambda: mixing.repeat(mixing.mix(rows)), "judge": lambda: urlfilter.judge(rows, rules, url="text"),
        "place": lambda: sharding.place(rows, "doc_id", ["a", "b"], spread="text"), "clean": lambda: decontam.clean(rows, bench),
        "trusted_like": lambda: ngramquality.trusted_like(rows, labels(spark)), "one_of_each": lambda: neardup.one_of_each(rows),
    }[name]()
    assert Counter(found.columns) == Counter({*rows.columns, *ADDED[name]})
    got = found.collect()
    ids = Counter(x["doc_id"] for x in got)
    assert set(ids) == {"clean": {0, 1, 2, 3, 4}, "one_of_each": {0, 2, 3, 4, 5}, "repeat": set(ids)}.get(name, set(range(6)))
    for c in set(internal_names()) - ADDED[name]:
        assert all(x[c] == f"{c} {x['doc_id']}" for x in got), c


def test_items_of_any_type(spark, rows):
    bench = spark.createDataFrame([("q2", "alpha beta gamma delta epsilon zeta eta theta"), ("q1", "alpha beta gamma delta epsilon zeta eta theta"), (None, "alpha beta gamma delta epsilon zeta eta theta")], "item_id string, text string")
    found = {x["doc_id"]: (x["contaminated"], x["item_id"], x["n_items"]) for x in decontam.contamination(rows, bench).collect()}
    assert found[5] == (True, "q1", 3) and found[0] == (False, None, 0)
