"""Shard placement by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size
(offset and skip hashed from its name). Shards take turns, each claiming the
first slot of its permutation that is still free, until the table is full. A
document's key is hashed to a slot. Shards get equal shares, one slot apart at
most, and adding or removing a shard moves few keys.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime, over a hundred times the usual number of shards.
SLOTS = 8191


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of every slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must have different names and be no more than the slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    starts = []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        starts.append((int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1))
    table, tried, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for k, (offset, skip) in enumerate(starts):
            if not left:
                break
            while table[slot := (offset + tried[k] * skip) % slots] >= 0:
                tried[k] += 1
            table[slot] = k
            tried[k] += 1
            left -= 1
    return table


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """df with slot and shard (columns of these names are replaced).

    The slot is the leading 60 bits of the key's MD5, as text, modulo the
    table's size; a null key counts as the empty text. Equal keys share a
    shard. The table, of fixed size, is broadcast.
    """
    found = lookup_table(shards or shard_names(64), slots)
    spark = df.sparkSession
    rows = F.broadcast(spark.createDataFrame(list(enumerate(found)), "slot long, shard int"))
    digest = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15)
    slot = F.conv(digest, 16, 10).cast("long") % F.lit(slots)
    return df.drop("slot", "shard").withColumn("slot", slot).join(rows, "slot").select(*(c for c in df.columns if c not in ("slot", "shard")), "slot", "shard")
