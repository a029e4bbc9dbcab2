"""Near-duplicate documents by min-max hashing.

Each of P permutations of the hashed shingles gives two signature values, its minimum and its maximum; both are
unbiased, so P hash evaluations make a signature of 2P values. Bands of four values make the candidate buckets, and
links are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from . import textbytes
from .common import Carried, lean, removed, small, text_keys, written
from .graph import components

BANDS, ROWS = 36, 4
PERMUTATIONS = BANDS * ROWS // 2
#: Turns of tests against likely hubs: hubs of a bucket, and tests of a node.
TURNS = ((3, 3),)

_random = np.random.default_rng(20_240_901)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of n permutations of the 64-bit values."""
    return _random.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), _random.integers(0, 1 << 63, n, np.uint64)


#: Values that signature() works out at a time.
AT_ONCE = 1 << 18

_SHORT = _permutations(PERMUTATIONS)
_LONG = _permutations(2000)


def long_bands(percent: int) -> tuple[int, int]:
    """Bands and rows of a second, more selective signature; a pair at the threshold misses it 1 time in 100,000."""
    for rows in (12, 8, 6, 4, 2):
        n = ceil(log(1e-5) / log(1 - (percent / 100) ** rows)) if percent < 100 else 1
        if n <= 200 or rows == 2:
            return n, rows
    raise AssertionError


def least_shared(percent: int) -> int:
    """The most shared bands that a linked pair still has but for a chance of 1 in 100,000, and at least two."""
    p = (percent / 100) ** ROWS
    k, below = 0, 0.0
    while True:
        below += comb(BANDS, k) * p**k * (1 - p) ** (BANDS - k)
        if below > 1e-5:
            return max(2, k)
        k += 1


def signature(found: np.ndarray, permutations: tuple[np.ndarray, np.ndarray] = _SHORT) -> np.ndarray:
    """Minimum and maximum of a non-empty set of hashes under each permutation, in turn."""
    a, b = permutations
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(a), np.uint64)
    step = max(1, AT_ONCE // len(a))
    for k in range(0, len(found), step):
        x = found[k : k + step] * a[:, None] + b[:, None]
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def bands(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of a signature; bands have keys of their own."""
    x = values.reshape(-1, rows)
    key = textbytes.mixed(np.arange(1, len(x) + 1, dtype=np.uint64))
    for k in range(rows):
        key = textbytes.mixed(key * np.uint64(3) + x[:, k])
    return key


def _set_key(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = textbytes.mixed(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = textbytes.mixed(found + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    n = np.uint64(len(found))
    return int(textbytes.mixed(np.array([a + n]))[0].view(np.int64)), int(textbytes.mixed(np.array([b ^ n]))[0].view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit values as one Arrow list column."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64)))


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """Per row of (doc_id, text): its text's keys t1 and t2, n_shingles, the set's key, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textbytes.blocks(batch.column(3)):
                sets = textbytes.shingles(block, size)
                keys = [_set_key(x) for x in sets]
                made = [bands(signature(x)) if len(x) else np.zeros(0, np.uint64) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(k).slice(block.first, block.last - block.first) for k in range(3)],
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        _lists(made),
                    ],
                    ["doc_id", "t1", "t2", "n_shingles", "set_a", "set_b", "bands"],
                )

    kinds = "doc_id long, t1 long, t2 long, n_shingles long, set_a long, set_b long, bands array<long>"
    return lean(docs.select("doc_id", *text_keys(F.col("text")), "text")).mapInArrow(run, kinds)


def _sets_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame, size: int, once: bool, percent: int | None = None) -> DataFrame:
    """(node, shingles) of some nodes, made again from the text of one document of each class.

    With percent also n and long_bands: the set's size, and the bands of the second signature for that threshold. once
    says that no doc_id is repeated, so no row of docs can come twice.
    """
    n, rows = long_bands(percent) if percent else (0, 1)
    permutations = _LONG[0][: n * rows // 2], _LONG[1][: n * rows // 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textbytes.blocks(batch.column(1)):
                sets = textbytes.shingles(block, size)
                columns = {"node": batch.column(0).slice(block.first, block.last - block.first), "shingles": _lists(sets)}
                if percent:
                    columns |= {"n": pa.array([len(x) for x in sets], pa.int32()), "long_bands": _lists([bands(signature(x, permutations), rows) for x in sets])}
                yield pa.RecordBatch.from_pydict(columns)

    wanted = written(classes.join(nodes, "node").select("node", "rep", F.col("t1").alias("r1"), F.col("t2").alias("r2")), "needed")
    needed = small(wanted)
    texts = docs.select("doc_id", "text", *text_keys(F.col("text")))
    texts = texts.join(needed, texts["doc_id"].eqNullSafe(needed["rep"]) & (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2")))
    kinds = "node long, shingles array<long>" + (", n int, long_bands array<long>" if percent else "")
    made = lean(texts.select("node", "text")).mapInArrow(run, kinds)
    made = written(made if once else made.dropDuplicates(["node"]), "sets")
    removed(wanted)
    return made


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets meet the threshold."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    with_a = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return written(
        with_a.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("all"))
        .where(100 * F.col("both") >= percent * (F.col("all") - F.col("both")))
        .select("a", "b"),
        "linked",
    )


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members (bucket, node) with each node's label, of the buckets that hold more than one label."""
    if labels is None:
        named = members.withColumn("label", F.col("node"))
    else:
        named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where(F.col("x") != F.col("y"))
    return written(named.join(mixed.select("bucket"), "bucket").select("bucket", "node", "label"), "open-buckets")


def _likely(open_: DataFrame, turn: int, hubs: int, tries: int, shared: int) -> DataFrame:
    """For each node the hubs of its buckets, of another label, with which it shares most buckets; ``tries`` at most.

    Each bucket has up to ``hubs`` hubs: the node whose buckets have most members in all, as a text that is nearest to
    its copies has, and others drawn by hash. So a bucket of any size gives as many rows as members and hubs.
    """
    sizes = open_.groupBy("bucket").agg(F.count("*").alias("size"))
    weight = open_.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("weight"))
    rows = written(open_.join(weight, "node"), "weighed")
    named = [F.col("node").alias("n"), F.col("label").alias("l")]
    drawn = [F.max(F.struct("weight", *named))]
    drawn += [F.min(F.struct(F.xxhash64("node", F.lit(1000 * turn + k)).alias("h"), *named)) for k in range(1, hubs)]
    hub = rows.groupBy("bucket").agg(*[d.alias(f"h{k}") for k, d in enumerate(drawn)])
    hub = hub.select("bucket", F.explode(F.array_distinct(F.array(*[F.struct(f"h{k}.n", f"h{k}.l") for k in range(hubs)]))).alias("hub"))
    met = open_.join(hub, "bucket").where(F.col("label") != F.col("hub.l")).groupBy("node", F.col("hub.n").alias("other")).count()
    first = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("count"), "other"))
    best = met.where(F.col("count") >= shared).withColumn("k", first).where(F.col("k") <= tries)
    pairs = written(best.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct(), "likely")
    removed(rows)
    return pairs


def _references(rows: DataFrame) -> DataFrame:
    """(ref, node) of rows (bucket, node), so that any two nodes of a bucket have a ref in common.

    A bucket's ref is the heaviest node that its members share any bucket with (the weight is the size of a node's buckets
    in all), so the buckets of a large group mostly have one ref.
    """
    sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("size")), "bucket-sizes")
    weight = written(rows.join(small(sizes), "bucket").groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    known = rows.join(small(weight), "node").select("bucket", "node", F.struct("weight", "node").alias("ref"))
    for turn in range(2):
        best = written(known.groupBy("bucket").agg(F.max("ref").alias("ref")), "bucket-references")
        known = rows.join(small(best), "bucket")
        if not turn:
            near = written(known.groupBy("node").agg(F.max("ref").alias("ref")), "near-references")
            known = rows.join(small(near), "node")
    return written(known.select(F.col("ref.node").alias("ref"), "node").distinct(), "references")


def _differences(refs: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """refs (ref, node) with each node's label, what it and its ref don't both hold (delta), and its score.

    Sets x and y of one ref share the threshold if (100 + percent) * |delta_x ^ delta_y| <= (100 - percent) * (n_x + n_y), as
    the ref drops out. With score = (100 + percent) * |delta| - (100 - percent) * n, that is 2 * (100 + percent) * shared >=
    score_x + score_y, where shared counts what both deltas hold. So two with scores of 0 or less in sum are linked, and each of
    them with the node of the ref's least score (least). A node's group is that one's label if they are linked so, else its own;
    a straggler isn't of the ref's largest group.
    """
    theirs = written(sets.join(refs.select(F.col("ref").alias("node")).distinct(), "node").select(F.col("node").alias("ref"), F.col("shingles").alias("theirs")), "reference-sets")
    rows = refs.join(sets.select("node", "n", "shingles"), "node").join(labels, "node").join(small(theirs), "ref")
    delta = F.concat(F.array_except("shingles", "theirs"), F.array_except("theirs", "shingles"))
    rows = rows.select("ref", "node", "label", "n", delta.alias("delta"))
    score = (100 + percent) * F.size("delta").cast("long") - (100 - percent) * F.col("n")
    rows = written(rows.withColumn("score", score).drop("n"), "differences")
    least = written(rows.groupBy("ref").agg(F.min(F.struct("score", "node", "label")).alias("least")), "least-scores")
    group = F.when(F.col("score") + F.col("least.score") <= 0, F.col("least.label")).otherwise(F.col("label"))
    rows = rows.join(small(least), "ref").withColumn("group", group)
    top = rows.groupBy("ref", "group").count().groupBy("ref").agg(F.max(F.struct("count", "group")).alias("top"))
    top = written(top.select("ref", F.col("top.group").alias("top")), "largest-groups")
    return rows.join(small(top), "ref").withColumn("straggler", F.col("group") != F.col("top")).drop("top")


def _rest(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of open nodes of different labels that share a long band, such that their links join all that may be joined.

    The nodes of a bucket are told by how they differ from a ref that they have in common, see _differences(). Pairs with the
    least score's node stand for all that are linked by their scores alone. Any other pair has to share differences, so it
    meets at one that both hold. Differences are in order, the rarest first, so at the first that a pair shares no more are
    left than either has from there on; the join drops what can't reach the threshold with these, without a loss. What a
    single node differs in meets nothing. Pairs of one group are left out.
    """
    labels = open_.select("node", "label").distinct()
    named = sets.select("node", "long_bands").join(labels, "node")
    named = named.select("node", "label", F.explode("long_bands").alias("bucket"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where(F.col("x") != F.col("y"))
    rows = written(named.join(mixed.select("bucket"), "bucket").select("bucket", "node"), "open-long-buckets")
    apart = _differences(_references(rows), sets, labels, percent)
    near = apart.where((F.col("score") + F.col("least.score") <= 0) & (F.col("label") != F.col("least.label")))
    near = near.select("node", F.col("least.node").alias("s_node"))

    each = apart.select("ref", "node", "group", "score", "straggler", F.col("least.score").alias("lowest"), F.explode("delta").alias("part"))
    held = each.groupBy("ref", "part").agg(F.count("*").alias("holders"), F.count_if("straggler").alias("stragglers"))
    held = written(held.where("holders > 1 AND stragglers > 0").drop("stragglers"), "shared-differences")
    # The number of differences that a node has from this one on.
    left = F.row_number().over(Window.partitionBy("ref", "node").orderBy(F.desc("holders"), F.desc("part")))
    parts = each.join(held, ["ref", "part"]).withColumn("left", left).where(2 * (100 + percent) * F.col("left") >= F.col("score") + F.col("lowest"))
    parts = written(parts.drop("lowest", "holders"), "ordered-differences")
    s = parts.where("straggler").select(*[F.col(c).alias(f"s_{c}") for c in parts.columns])
    met = (
        (F.col("ref") == F.col("s_ref"))
        & (F.col("part") == F.col("s_part"))
        & (F.col("group") != F.col("s_group"))
        & (~F.col("straggler") | (F.col("s_node") < F.col("node")))
        & (F.col("score") + F.col("s_score") > 0)
        & (2 * (100 + percent) * F.least("left", "s_left") >= F.col("score") + F.col("s_score"))
    )
    pairs = near.union(s.join(parts, met).select("node", "s_node"))
    pairs = written(pairs.select(F.greatest("s_node", "node").alias("a"), F.least("s_node", "node").alias("b")).distinct(), "rest")
    removed(rows, parts)
    return pairs


def _empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def _through_ids(sketch: DataFrame, classes: DataFrame) -> tuple[DataFrame | None, bool]:
    """Edges between the classes of one doc_id's texts, None without any; and whether no doc_id is repeated."""
    differ = (F.min("set_a") != F.max("set_a")) | (F.min("set_b") != F.max("set_b"))
    ids = sketch.groupBy("doc_id").agg(F.count("*").alias("rows"), differ.alias("differ"))
    ids = written(ids.where("rows > 1").select("doc_id", "differ"), "repeated-ids")
    if _empty(ids):
        return None, True
    several = ids.where(F.col("differ") & F.col("doc_id").isNotNull()).select("doc_id")
    rows = sketch.where("n_shingles > 0").join(several, "doc_id").select("doc_id", "set_a", "set_b").distinct()
    named = written(rows.join(classes, ["set_a", "set_b"]).select("doc_id", "node"), "nodes-of-ids")
    first = named.groupBy("doc_id").agg(F.min("node").alias("b"))
    edges = written(named.join(first, "doc_id").where("node != b").select(F.col("node").alias("a"), "b"), "links-of-ids")
    return (None if _empty(edges) else edges), False


def _groups(docs: DataFrame, size: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """The sketch of docs, and (set_a, set_b, label) with the component of each set; with by_id, ids link as well.

    Candidates: pairs that share at least least_shared(percent) of the bands, which a pair at the threshold misses
    with a chance below 1 in 100,000. A turn links nodes to their likeliest hubs, which settles most of a large group
    with a few pairs a node; then all pairs that may still join two components are tested, found by the longer bands of a
    second signature. No bucket is capped. A node is a set, numbered once the table of sets is written.
    """
    shared = least_shared(percent)
    banded = written(_sketched(docs, size), "banded-sketch")
    sketch = written(banded.drop("bands"), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t1", "t2")).alias("first")
    classes = banded.where(F.col("n_shingles") > 0).groupBy("set_a", "set_b").agg(first, F.any_value("bands").alias("bands"))
    classes = classes.select(
        F.monotonically_increasing_id().alias("node"), "set_a", "set_b", F.col("first.doc_id").alias("rep"), "first.t1", "first.t2", "bands"
    )
    banded_classes = written(classes, "banded-classes")
    removed(banded)
    classes = written(banded_classes.drop("bands"), "classes")
    every = banded_classes.select("node", F.explode("bands").alias("bucket"))
    many = every.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where(F.col("x") != F.col("y"))
    members = written(every.join(many.select("bucket"), "bucket").select("bucket", "node").distinct(), "members")
    removed(banded_classes)

    links, once = _through_ids(sketch, classes.select("set_a", "set_b", "node"))
    links = links if by_id else None
    labels = None if links is None else written(components(links), "labels")
    open_ = _labelled(members, labels)
    for turn in range(len(TURNS) + 1):
        if _empty(open_):
            break
        if turn < len(TURNS):
            pairs = _likely(open_, turn, *TURNS[turn], shared)
        else:
            sets = _sets_of(open_.select("node").distinct(), docs, classes, size, once, percent)
            pairs = _rest(open_, sets, percent)
        if _empty(pairs):
            continue
        if turn < len(TURNS):
            sets = _sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), docs, classes, size, once)
        new = _confirmed(pairs, sets, percent)
        removed(sets, pairs)
        if _empty(new):
            continue
        links = new if links is None else links.union(new)
        labels = written(components(links), "labels")
        if turn < len(TURNS):
            removed(open_)
            open_ = _labelled(members, labels)

    removed(members, open_)
    named = classes.select("set_a", "set_b", "node", "rep")
    if labels is None:
        return sketch, written(named.withColumnRenamed("node", "label"), "components")
    named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return sketch, written(named.drop("node"), "components")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id and kept.

    Words are A-Z lower-cased; a document's set has its distinct runs of ``size`` words, or with fewer words its whole
    sequence. Documents are linked if 100 * intersection >= percent * union. component_id is the smallest doc_id
    reachable, kept is doc_id = component_id. Equal sets are one class from the start, however many documents share it.

    Null, empty and wordless texts have empty sets and no links, so their own doc_id. Rows that share a doc_id are
    linked through it, whatever their texts, and every text's own links count. A null doc_id links nothing, but such
    a row's text takes part in links; it gets its component's id (null if that has no other), and is not kept.
    Repeated rows give repeated rows, ties don't occur, texts of any length count in full. An empty table gives an empty
    table; other columns, whatever their names, are left out.
    """
    sketch, named = _groups(docs, size, percent, True)
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("set_a", "set_b", "component_id")
    found = sketch.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (doc_id, text), with all their columns, whatever their names, less near-duplicates: one row of each group stays.

    Rows are judged by their texts, as in near_duplicates() but without links through ids: the row with the smallest
    doc_id stays (null last; of the same doc_id the first by a hash of the text), whatever the order of the rows. Of rows
    that repeat it in doc_id and text one stays, the first by all columns. Null, empty and wordless texts are in no group
    and all stay, as do different texts under one doc_id. An empty table stays empty.
    """
    carried = Carried(docs, "doc_id", "text")
    docs = carried.df
    sketch, named = _groups(docs, size, percent, False)
    rows = sketch.where("n_shingles > 0").join(named.select("set_a", "set_b", "label"), ["set_a", "set_b"])
    rows = written(rows.select("label", F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t1", "t2"), "group-rows")
    first = rows.groupBy("label").agg(F.min(F.struct("unnamed", "doc_id", "t1", "t2")).alias("first"), F.count("*").alias("rows"))
    first = written(first.where("rows > 1").select("label", "first"), "first-rows")
    us = F.struct("unnamed", "doc_id", "t1", "t2")
    judged = rows.join(first, "label").withColumn("stays", us.eqNullSafe(F.col("first")))
    judged = judged.groupBy("doc_id", "t1", "t2", "stays").agg(F.count("*").alias("rows"))
    judged = written(judged.where(~F.col("stays") | (F.col("rows") > 1)).select(F.col("doc_id").alias("j_id"), F.col("t1").alias("j1"), F.col("t2").alias("j2"), "stays"), "duplicates")
    key1, key2 = text_keys(F.col("text"))
    same = F.col("doc_id").eqNullSafe(F.col("j_id")) & (F.col("_t1") == F.col("j1")) & (F.col("_t2") == F.col("j2"))
    keyed = docs.withColumns({"_t1": key1, "_t2": key2})
    repeated = judged.where("stays")
    if _empty(repeated):
        return carried.back(keyed.join(small(judged), same, "left_anti").drop("_t1", "_t2"))
    rest = keyed.join(small(judged), same, "left_anti")
    again = keyed.join(small(repeated), same, "left_semi")
    whole = F.min_by(F.struct(*docs.columns), F.xxhash64(*[f.name for f in docs.schema if not isinstance(f.dataType, MapType)]))
    one = again.groupBy("_t1", "_t2", F.col("doc_id").alias("_id")).agg(whole.alias("row")).select("row.*")
    return carried.back(rest.select(docs.columns).union(one))
