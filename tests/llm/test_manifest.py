"""The Merkle manifest against a plain tree, with every shape of bucket, and odd inputs."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewright.llm import manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fan):
    """The root, and for each node its siblings level by level."""
    proofs, own, now = [[] for _ in nodes], [[k] for k in range(len(nodes))], list(nodes)
    while len(now) > 1:
        up, owners = [], []
        for k in range(0, len(now), fan):
            run = now[k : k + fan]
            for j in range(len(run)):
                for i in own[k + j]:
                    proofs[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            owners.append([i for x in own[k : k + fan] for i in x])
        now, own = up, owners
    return now[0], proofs


def plain(rows, fan):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = {}, []
    for name in names:
        leaves = sorted((row[0] is not None, row[0] or 0, leaf(row)) for row in groups[name])
        subroot, proofs = tree([x[2] for x in leaves], fan)
        subroots.append(subroot)
        found[name] = [(*x, p) for x, p in zip(leaves, proofs, strict=True)]
    root, outer = tree(subroots, fan)
    return [
        (x[1] if x[0] else None, name, x[2], subroots[k], root, [*x[3], *outer[k]]) for k, name in enumerate(names) for x in found[name]
    ]


def key(x):
    return str(x)


def table(seed):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice(["a", "a", "a", "b", "c", None, "é", ""]), "en", k, f"t{k}\nx" * rnd.randrange(4)) for k in range(400)]
    rows += [(k, f"s{k}", None, None, None) for k in range(1000, 1037)]
    rows += [(5, "a", "en", 1, "again"), (5, "a", "en", 1, "again"), (None, "a", None, None, None), (None, "a", None, None, "x"), (None, None, None, None, None)]
    rows += [(10_000 * n + k, f"of {n}", None, k, "t") for n in (1, 2, 3, 4, 9, 10, 27, 28, 82) for k in range(n)]
    rows += [(7000, "long", "de", 1, "ä " * 300_000)]
    return rows


@pytest.mark.parametrize(("fan", "levels"), [(3, 7), (3, 2), (4, 1)])
def test_against_a_plain_tree(spark, fan, levels):
    rows = table(fan)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    extra = {c: F.lit("x") for c in ("leaf", "root", "pos", "n", "grp", "hash", "kept", "turn", "place", "range", "block", "proof")}
    found = manifest.manifest(docs.withColumns(extra), fan=fan, levels=levels)
    assert found.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof"]
    checked = manifest.verified(found, "leaf").withColumn("digest", manifest.proof_digest(F.col("proof"))).collect()
    got = [(x["doc_id"], x["source"], x["leaf"], x["subroot"], x["root"], [tuple(p) for p in x["proof"]]) for x in checked]
    assert sorted(got, key=key) == sorted(plain(rows, fan), key=key)
    assert all(x["verified"] and x["folded_root"] == x["root"] for x in checked)
    assert all(x["digest"] == h("".join(a + b for a, b in x["proof"])) for x in checked)


def test_changes_show(spark):
    rows = table(9)[:60]
    docs = spark.createDataFrame(rows, DOCS)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = manifest.leaf(*columns, F.regexp_replace("text", "\n", ""))
    found = manifest.verified(manifest.manifest(docs, keep={"changed": changed, "n": F.col("n_chars"), "of a": F.lit(1.5)}), "changed").collect()
    texts = {row[0]: row[4] for row in rows}
    assert all(x["verified"] == ("\n" not in texts[x["doc_id"]]) and x["n"] == x["doc_id"] and x["of a"] == 1.5 for x in found)
    with pytest.raises(ValueError, match="taken"):
        manifest.manifest(docs, keep={"root": F.lit(1)})


def test_empty(spark):
    found = manifest.manifest(spark.createDataFrame([], DOCS))
    assert manifest.verified(found, "leaf").count() == 0
