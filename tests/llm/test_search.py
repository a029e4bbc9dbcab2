"""Ranked search: postings, the merge against sorting all sums, and a search against plain loops."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import prose, word

from tidewright.llm import search
from tidewright.llm.common import written

TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_variable_length_bytes():
    rnd = random.Random(1)
    values = [0, 1, 127, 128, 16383, 16384, (1 << 62) - 1] + [rnd.getrandbits(rnd.randrange(1, 60)) for _ in range(500)]
    data, begin = search.packed(np.array(values))
    assert search.unpacked(data.tobytes()).tolist() == values
    for k in (0, 5, 300):
        assert search.unpacked(data[begin[k] :].tobytes()).tolist() == values[k:]
    assert len(data[: begin[3]]) == 3 and not len(search.unpacked(b""))


@pytest.mark.parametrize("top", [1, 3, 20])
def test_merge_against_sorting_all(top):
    """Many equal sums, terms that score nothing, and terms that leave the heap."""
    rnd = random.Random(top)
    for turn in range(150):
        lists, sums = [], Counter()
        for _ in range(rnd.randint(1, 8)):
            docs = sorted(rnd.sample(range(200), rnd.randint(1, 150)))
            high = rnd.choice([1, 3, 50, 1000])
            scores, times = [rnd.randint(0, high) for _ in docs], rnd.randint(1, 3)
            lists.append((search.Postings(np.array(docs), np.array(scores), top), times))
            for d, s in zip(docs, scores, strict=True):
                sums[d] += s * times
        want = sorted(((s, d) for d, s in sums.items() if s), key=lambda x: (-x[0], x[1]))[:top]
        assert sorted(search.best(lists, top), key=lambda x: (-x[0], x[1])) == want, turn


def plain(docs, queries, top):
    found = [(k, Counter(terms(t))) for k, t in docs]
    n = [sum(c.values()) for _, c in found]
    with_terms, words = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in queries:
        sums = []
        for (k, c), size in zip(found, n, strict=True):
            m = 75 + 25 * size * with_terms // max(words, 1)
            score = sum(math.floor(1000 * math.log((2 * with_terms + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                sums.append((-score, k is None, k or 0))
        out += [(item, r + 1, None if none else k, -s) for r, (s, none, k) in enumerate(sorted(sums)[:top])]
    return sorted(map(str, out))


def test_search_against_plain_loops(spark, monkeypatch):
    rnd = random.Random(7)
    words = [word(rnd) for _ in range(150)] + ["été", "Ünï", "a1", "中文"]
    docs = [(k, prose(rnd, rnd.randint(0, 60), words)) for k in range(300)]
    docs += [(k, docs[5][1]) for k in (900, 901, 5)] + [(None, docs[9][1]), (None, None), (903, None), (904, ""), (905, " ..\n- "), (906, "WORD word-Word, " * 50_000)]
    queries = [(k, prose(rnd, rnd.randint(1, 12), words)) for k in range(25)]
    queries += [(3, docs[5][1]), (3, "word WORD"), (None, "été a1"), (70, None), (71, ""), (72, "!?"), (73, "nowhere")]
    monkeypatch.setattr(search, "SHARD_DOCS", 40)
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 10)
    extra = {c: F.lit("x") for c in ("shard", "term", "df", "data", "query", "rank", "score", "item", "part", "uses")}
    made = written(search.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns(extra)), "index")
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumns(extra)
    got = search.search(made, asked, top=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(x)) for x in got.collect()) == plain(docs, queries, 7)
    assert made.where("term is null").agg(F.sum("df"), F.sum("tf")).first()[:] == (sum(bool(terms(t)) for _, t in docs), sum(len(terms(t)) for _, t in docs))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "some words")], "item_id string, text string")
    assert search.search(written(search.index(docs), "index"), asked).count() == 0
    made = written(search.index(spark.createDataFrame([(1, "some words")], docs.schema)), "index")
    assert [tuple(x)[:3] for x in search.search(made, asked).collect()] == [("q", 1, 1)]
    assert search.search(made, asked.limit(0)).count() == 0
