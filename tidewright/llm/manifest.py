"""A Merkle manifest of a table: a leaf digest for each row, a tree for each group, and a tree over the groups' roots.

Nodes are numbered within their group by a range sort, and cut in buckets of fan ** levels consecutive nodes, so that a
bucket is a whole subtree. Executors fold buckets with DuckDB, a level at a time, on the Arrow rows of a block of buckets;
Spark keeps the bucket roots, which are the nodes of the next climb. A second pass, downwards, gives every node the
siblings that its root needs: those in its bucket from DuckDB, and those above from a join with the bucket's own proof.
So no task holds more than a bucket, whatever share of the rows its group has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import key_text, written

FAN = 3
#: Levels that a bucket spans: FAN ** LEVELS nodes.
LEVELS = 7

PROOF = "array<struct<left string, right string>>"
_NODE = "grp string, n long, pos long, hash string"


def encoded(column: Column) -> Column:
    """A value as its UTF-8 byte count, ':' and its text; null as '-'."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest of a row: lower-case hex sha256 of its encoded values, one after the other."""
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a digest leads to: at each level the digest of left siblings, itself and right siblings."""
    return F.aggregate(proof, digest, lambda below, level: F.sha2(F.concat(level["left"], below, level["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (grp, ...) with pos, the place within the group in order, and n, the group's rows.

    Rows are dealt in ranges of (group, order), so a group of any size lies in many tasks; rows that are equal in all of
    that are dealt by their place in the input. Places count from the rows of the group in the ranges before.
    """
    rows = rows.withColumn("turn", F.monotonically_increasing_id())
    by = ["grp", *order, "turn"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    rows = written(rows.drop("turn"), "ranged").withColumn("range", F.shiftright("place", 33))
    ranges = rows.groupBy("grp", "range").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("grp")
    before = F.coalesce(F.sum("rows").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("grp", "range", (before - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n"))
    return rows.join(ranges, ["grp", "range"]).withColumn("pos", F.col("place") + F.col("shift")).drop("place", "range", "shift")


def _blocks(nodes: DataFrame, width: int) -> Callable[[Column], Column]:
    """A function from the bucket (of a row with grp and n) to its block: what one task folds at once.

    A bucket of a large group is a block of its own; small groups share blocks that hold about a bucket's nodes. Whether
    two buckets share a block makes no difference to the result, so equal hashes do no harm.
    """
    few = nodes.agg(F.coalesce(F.sum(F.when(F.col("n") <= width, 1)), F.lit(0))).first()[0]
    shared = F.pmod(F.xxhash64("grp"), F.lit(1 + few // width))
    return lambda bucket: F.when(F.col("n") > width, F.xxhash64("grp", bucket)).otherwise(F.xxhash64(shared))


def _duck():
    """A DuckDB connection for one block: in memory, one thread, without files of its own."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def _climbed(con, fan: int, levels: int) -> None:
    """Make tables l0 (from nodes) to l<levels>, each with the nodes of one level; a group with one node stays as it is."""
    con.execute("CREATE TABLE l0 AS SELECT grp, n, pos, hash FROM nodes")
    for k in range(levels):
        con.execute(
            f"CREATE TABLE l{k + 1} AS SELECT grp, any_value((n + {fan - 1}) // {fan}) AS n, pos // {fan} AS pos, "
            f"CASE WHEN any_value(n) = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY pos)) END AS hash "
            f"FROM l{k} GROUP BY grp, pos // {fan}"
        )


def _roots(nodes: DataFrame, block: Column, fan: int, levels: int) -> DataFrame:
    """The root of each bucket as a node (grp, n, pos, hash) of the next climb; of a group with one node that node."""

    def run(nodes: pa.Table) -> pa.Table:
        with _duck() as con:
            con.register("nodes", nodes)
            _climbed(con, fan, levels)
            return con.sql(f"SELECT grp, n, pos, hash FROM l{levels}").to_arrow_table()

    rows = nodes.select("grp", "n", "pos", "hash", block.alias("block"))
    return written(rows.groupBy("block").applyInArrow(run, _NODE), "bucket-roots")


def _proofs(nodes: DataFrame, above: DataFrame, blocks: Callable[[Column], Column], fan: int, levels: int) -> DataFrame:
    """nodes with the columns of above (grp, n, pos of the bucket, proof, ...), their own siblings put before its proof.

    A block's nodes and the proofs of its buckets come together, so a proof is joined once a bucket, not once a node.
    """
    width, own = fan**levels, [f for f in nodes.schema if f.name != "proof"]
    extra = [f for f in above.schema if f.name not in ("grp", "n", "pos", "proof")]
    kinds = StructType([*own, *extra, above.schema["proof"]])

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        with _duck() as con:
            con.register("nodes", nodes.select(["grp", "n", "pos", "hash"]).append_column("i", pa.array(range(nodes.num_rows), pa.int64())))
            con.register("above", above.select(["grp", "pos", "proof"]).append_column("j", pa.array(range(above.num_rows), pa.int64())))
            _climbed(con, fan, levels)
            con.execute(f"CREATE TABLE p{levels} AS SELECT grp, pos, proof FROM above")
            for k in range(levels - 1, -1, -1):
                run_of = f"OVER (PARTITION BY grp, pos // {fan} ORDER BY pos ROWS BETWEEN"
                con.execute(
                    f"CREATE TABLE p{k} AS SELECT s.grp, s.pos, CASE WHEN s.n = 1 THEN p.proof ELSE list_prepend("
                    f"{{'left': coalesce(s.l, ''), 'right': coalesce(s.r, '')}}, p.proof) END AS proof FROM (SELECT grp, n, pos, "
                    f"string_agg(hash, '') {run_of} UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, "
                    f"string_agg(hash, '') {run_of} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM l{k}) s "
                    f"JOIN p{k + 1} p ON p.grp = s.grp AND p.pos = s.pos // {fan}"
                )
                con.execute(f"DROP TABLE p{k + 1}")
            found = con.sql(
                f"SELECT i, j, p0.proof FROM nodes JOIN p0 ON p0.grp = nodes.grp AND p0.pos = nodes.pos "
                f"JOIN above ON above.grp = nodes.grp AND above.pos = nodes.pos // {width}"
            ).to_arrow_table()
        rows, over = nodes.take(found["i"]), above.take(found["j"])
        columns = {f.name: rows[f.name] for f in own} | {f.name: over[f.name] for f in extra}
        return pa.table(columns | {"proof": found["proof"]})

    below = nodes.withColumn("block", blocks(F.floor(F.col("pos") / width))).groupBy("block")
    return below.cogroup(above.withColumn("block", blocks(F.col("pos"))).groupBy("block")).applyInArrow(run, kinds)


@dataclass
class _Climb:
    """The nodes of a climb, and how they are dealt in blocks."""

    nodes: DataFrame
    blocks: Callable[[Column], Column]


def _tree(nodes: DataFrame, fan: int, levels: int) -> tuple[list[_Climb], DataFrame]:
    """Every climb, and (grp, hash), the root of each group."""
    width, climbs, tops = fan**levels, [], None
    while True:
        climbs.append(_Climb(nodes, _blocks(nodes, width)))
        roots = _roots(nodes, climbs[-1].blocks(F.floor(F.col("pos") / width)), fan, levels)
        top = roots.where("n = 1").select("grp", "hash")
        tops = top if tops is None else tops.union(top)
        nodes = roots.where("n > 1")
        if not nodes.limit(1).count():
            return climbs, tops


def _descend(climbs: list[_Climb], groups: DataFrame, fan: int, levels: int) -> DataFrame:
    """The first climb's nodes, each with its proof up to its group's root and on with the proof in groups (grp, proof, ...).

    A climb in which a group has one bucket ends that group: its bucket's proof is the group's.
    """
    proofs: DataFrame | None = None
    for k in range(len(climbs) - 1, -1, -1):
        nodes = climbs[k].nodes
        last = nodes.where((F.col("pos") == 0) & (F.col("n") <= fan**levels)).select("grp", "n")
        above = groups.join(last, "grp").withColumn("pos", F.lit(0).cast("long"))
        if proofs is not None:
            sizes = nodes.where(F.col("n") > fan**levels).select("grp", "n").distinct()
            above = above.unionByName(proofs.drop("n", "hash").join(sizes, "grp"))
        proofs = _proofs(nodes, written(above, "outer-proofs"), climbs[k].blocks, fan, levels)
        if k:
            proofs = written(proofs, "bucket-proofs")
    return proofs


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "source",
    order: str = "doc_id",
    fan: int = FAN,
    levels: int = LEVELS,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row of docs: order and group as they are, leaf, subroot, root, proof, and the columns of keep.

    A leaf is the sha256 (lower-case hex) of the row's fields in the order given. The leaves of a group ascend by
    ``order`` (null first); every ``fan`` consecutive nodes become their sha256 (the last run may have fewer, even one)
    until one is left, the subroot; a lone leaf is its group's subroot. Subroots, by group (null first, then by the
    UTF-8 bytes), are folded likewise into root. proof has a level for each fold from the leaf to the root, with the
    siblings to the left and right in one text each, so fold(leaf, proof) gives root.

    Null values, empty and long texts are leaves like any other. Rows that share ``order`` follow each other by their
    leaves; repeated rows have equal leaves, so it doesn't matter which comes first. An empty table gives an empty table.
    Other columns are left out, whatever their names; keep has values to carry along, by the names they get.
    """
    if fan < 2 or levels < 1:
        raise ValueError("a node needs two children, a bucket one level")
    keep = keep or {}
    if clash := set(keep) & {order, group, "leaf", "subroot", "root", "proof"}:
        raise ValueError(f"names are taken: {sorted(clash)}")
    kept = F.struct(F.col(f"`{order}`").alias("order"), F.col(f"`{group}`").alias("group"), *[c.alias(name) for name, c in keep.items()])
    rows = docs.select(
        key_text(F.col(f"`{group}`")).alias("grp"), F.col(f"`{order}`").alias("ord"), leaf(*[F.col(f"`{c}`") for c in fields]).alias("hash"), kept.alias("kept")
    )
    leaves = written(_numbered(rows, ["ord", "hash"]).drop("ord"), "leaves")
    climbs, subroots = _tree(leaves.select("grp", "n", "pos", "hash"), fan, levels)
    climbs[0].nodes = leaves
    # A group's name is "null" or "=...": false before true puts null first.
    named = subroots.select(F.lit("").alias("grp"), (F.col("grp") != "null").alias("named"), F.col("grp").alias("own"), "hash")
    ranked = written(_numbered(named, ["named", "own"]).drop("named"), "subroots")
    outer, root = _tree(ranked.select("grp", "n", "pos", "hash"), fan, levels)
    outer[0].nodes = ranked
    top = root.select("grp", F.array().cast(PROOF).alias("proof"), F.col("hash").alias("root"))
    groups = _descend(outer, top, fan, levels)
    groups = written(groups.select(F.col("own").alias("grp"), "proof", F.col("hash").alias("subroot"), "root"), "group-proofs")
    found = _descend(climbs, groups, fan, levels)
    columns = [F.col("kept.order").alias(order), F.col("kept.group").alias(group), F.col("hash").alias("leaf"), "subroot", "root", "proof"]
    return found.select(*columns, *[F.col(f"kept.`{name}`").alias(name) for name in keep])


def verified(found: DataFrame, changed: str) -> DataFrame:
    """A manifest with folded_root, from the leaf in the column ``changed`` and the proof, and verified, whether it is root."""
    return found.withColumn("folded_root", fold(F.col(f"`{changed}`"), F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root"))
