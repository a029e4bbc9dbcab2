"""SimHash: fingerprints against plain counting, anchors for every split of bits, and components against all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import LETTERS, WORD, prose, word

from tidewright.llm import simhash, textbytes


def fingerprint(text, size=4):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", LETTERS)))
    runs = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def odd_texts():
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "one", "Two  Words", "a b c", "a b c d", "a b c d e", "ÀÉ é x 中 😀 b", prose(rnd, 70_000)]
    return texts + [prose(rnd, rnd.randint(1, 40)).title() for _ in range(60)] + ["x y " * 30, "\x0bq\x0c r\r\ns"]


def test_fingerprints():
    texts = odd_texts()
    got = [x for block in textbytes.blocks(pa.array(texts)) for x in simhash.fingerprints(block).tolist()]
    assert got == [fingerprint(t) for t in texts]


def test_code_covers_every_word():
    words = np.arange(1 << 23)
    for low in range(0, len(words), 1 << 20):
        part = words[low : low + (1 << 20)]
        place, code = simhash.near(part, 0)
        assert (place == np.arange(len(part))).all()
        assert np.bitwise_count(part ^ code).max() <= simhash.RADIUS
    codes = np.unique(simhash.near(words[::5], 0)[1])
    assert len(codes) == 4096 and min(np.bitwise_count(codes[1:] ^ codes[0])) == 7
    for over in (1, 2):
        x = np.array([0, 12345, (1 << 23) - 1, 777_777])
        place, code = simhash.near(x, over)
        for k in range(len(x)):
            assert sorted(code[place == k].tolist()) == codes[np.bitwise_count(codes ^ x[k]) <= 3 + over].tolist()


@pytest.mark.parametrize("parts", [((36, 1), (28, 2)), ((32, 2), (32, 1))])
def test_every_pair_meets_at_an_anchor(parts):
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 1 << 63, 400, np.uint64)
    homes = [set() for _ in x]
    for home, place, anchor in simhash.anchors(x, parts):
        if home:
            for p, a in zip(place.tolist(), anchor.tolist(), strict=True):
                homes[p].add(a)
    for bits in range(5):
        y = x.copy()
        for k in range(len(y)):
            for b in rnd.choice(64, bits, replace=False).tolist():
                y[k] ^= np.uint64(1 << b)
        met = set()
        for home, place, anchor in simhash.anchors(y, parts):
            met |= set() if home else {p for p, a in zip(place.tolist(), anchor.tolist(), strict=True) if a in homes[p]}
        assert met == set(range(len(x)))


def brute(values, distance):
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in combinations(sorted(set(values)), 2):
        if (a ^ b).bit_count() <= distance:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


@pytest.mark.parametrize(("few", "at_once", "salts"), [(1 << 14, 1 << 20, 8), (8, 50, 2)])
def test_components_against_all_pairs(spark, monkeypatch, few, at_once, salts):
    """Families around centres and long chains; with small limits groups are cut and compared one home at a time."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    rnd = random.Random(few)
    values = [0, 1, 15, 31, (1 << 64) - 1, (1 << 64) - 2]
    for _ in range(3):
        centre = rnd.getrandbits(64)
        values += [centre ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(150)]
        for _ in range(40):
            centre ^= sum(1 << k for k in rnd.sample(range(64), rnd.randint(3, 5)))
            values.append(centre)
    values += [rnd.getrandbits(64) for _ in range(100)]
    want = brute(values, 4)
    rows = [(v - (1 << 64) if v >> 63 else v,) for v in sorted(set(values))]
    got = simhash.links(spark.createDataFrame(rows, "fp long").repartition(3), salts=salts).collect()
    pairs = [(x["a"] % (1 << 64), x["b"] % (1 << 64)) for x in got]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in pairs:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    assert {v: root(v) for v in values} == want
    assert len(set(want.values())) < len(want) - 300


def test_documents(spark):
    rnd = random.Random(8)
    texts = odd_texts()
    for _ in range(4):
        base = prose(rnd, 300).split()
        for _ in range(12):
            copy = list(base)
            copy[rnd.randrange(300)] = word(rnd)
            texts.append(" ".join(copy))
    rows = [(k, t) for k, t in enumerate(texts)] + [(70, texts[70]), (None, texts[70]), (None, "by itself in this table"), (3, "another text of three")]
    extra = {c: F.lit("x") for c in ("fp", "node", "label", "least", "slot", "a", "b", "component_id")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra).repartition(3)
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [fingerprint(t) for _, t in rows]
    roots, least = brute(prints, 4), {}
    for (k, _), v in zip(rows, prints, strict=True):
        if k is not None:
            least[roots[v]] = min(k, least.get(roots[v], k))
    want = [str((k, f"{v:016x}", least.get(roots[v]))) for (k, _), v in zip(rows, prints, strict=True)]
    assert sorted(str(tuple(x)) for x in got.collect()) == sorted(want)


def test_odd_parameters(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="leave out"):
        simhash.links(spark.range(1).withColumnRenamed("id", "fp"), 5)
    with pytest.raises(ValueError, match="64 in all"):
        simhash.links(spark.range(1).withColumnRenamed("id", "fp"), parts=((36, 1), (27, 2)))
