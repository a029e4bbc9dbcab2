"""Families of near copies: the last turn of near_duplicates() makes few pairs, and loses no link."""

from __future__ import annotations

import random

import pytest
from test_operators import brute_components, prose, word

from tidewright.llm import neardup


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_stragglers_of_a_family_meet_few_members(spark, monkeypatch, size, percent):
    rnd = random.Random(90 + size)
    base = prose(rnd, 140).split()
    rows = []
    for k in range(300):
        copy = list(base)
        for _ in range(rnd.randrange(9)):
            copy[rnd.randrange(len(copy))] = word(rnd)
        if k % 10 == 0:  # a changed copy of a straggler, which only that one may link
            copy[20:60:5] = [word(rnd) for _ in range(8)]
            rows.append(" ".join([*copy[:-1], word(rnd)]))
        rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    rest, made = neardup._rest, []

    def counted(*arguments):
        pairs = rest(*arguments)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(neardup, "TURNS", ())  # all is left to the last turn
    monkeypatch.setattr(neardup, "_rest", counted)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()
    want = brute_components(rows, size, percent)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in got} == want
    assert len({v[1] for v in want.values()}) > 100  # many stay apart
    assert made and max(made) <= 3 * len(rows)
