"""Placement by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table; the shards take turns claiming the
first free slot they prefer, until the table is full. A row's key is hashed to a slot, and the slot names the shard:
constant time, near-equal shares, and few rows move when a shard is added or removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carried, key_text

#: A prime; the table has this many rows whatever the input, so it is broadcast.
SLOTS = 65_537


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in shards) of each slot. slots has to be a prime of at least the number of shards."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards have to be named, each once")
    if not _prime(slots) or slots < len(shards):
        raise ValueError("slots has to be a prime, no less than the number of shards")
    wants = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        wants.append([int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1])
    table, free = [-1] * slots, slots
    while True:
        for shard, want in enumerate(wants):
            while table[want[0]] >= 0:
                want[0] = (want[0] + want[1]) % slots
            table[want[0]] = shard
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of the md5 of its text, modulo the table; nulls share one slot."""
    return F.pmod(F.conv(F.substring(F.md5(key_text(key)), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, spread: str | None = None) -> DataFrame:
    """Add slot and shard (its name) to each row; columns of these names are replaced.

    Rows with equal keys share a shard. Rows with a null key share one as well, or with ``spread`` are placed by the text
    of that column, so that many of them don't fill one shard (rows null in both share one). Texts of any length, ties
    and repeated rows make no difference: a row's place follows from its key alone. Empty tables stay empty.
    """
    table = lookup_table(shards, slots)
    rows = [(slot, shards[shard]) for slot, shard in enumerate(table)]
    lookup = df.sparkSession.createDataFrame(rows, "_slot int, shard string")
    carried = Carried(df, *[c for c in (key, spread) if c not in ("slot", "shard", "_slot")])
    by = F.col(carried.others.get(key, f"`{key}`"))
    if spread:
        text = F.col(carried.others.get(spread, f"`{spread}`")).cast("string")
        by = F.when(by.isNotNull(), by.cast("string")).otherwise(F.concat(F.lit("~"), F.md5(text)))
    placed = carried.df.withColumn("slot", slot_of(by, slots))
    return carried.back(placed.join(F.broadcast(lookup), F.col("slot") == F.col("_slot"), "left").drop("_slot"))


def write_sharded(df: DataFrame, path: str) -> None:
    """Write placed rows as Parquet, one folder a shard. A shard of any size is written by many tasks."""
    df.drop("slot").write.partitionBy("shard").parquet(path)
