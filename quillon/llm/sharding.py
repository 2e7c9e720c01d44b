"""Sharding by a permutation-filled lookup table.

Each shard has a permutation of the slots of a prime-sized table, given by an offset and a step; the shards take turns
claiming the next free slot of their permutation until the table is full. A key's slot is its hash modulo the table
size, so placement is one array lookup. Adding or removing a shard moves few keys besides those it must.

Defined results: a null key has a hash of its own and is placed like any other; repeated keys go to one shard; an
empty table gives no rows; other columns pass through, and clashing names raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime; 100 slots a shard or more keep shards within a per cent or two of each other.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """The shard number in each slot. weights: how many slots a shard claims a turn."""
    if not _is_prime(size):
        raise ValueError("the table size must be a prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and no more than slots")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one positive weight per shard is needed")
    at, step = [], []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(h[:8], "big") % size)
        step.append(int.from_bytes(h[8:16], "big") % (size - 1) + 1)
    table, left = [-1] * size, size
    while left:
        for i, turns in enumerate(weights):
            for _ in range(min(turns, left)):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % size
                table[at[i]], left = i, left - 1
    return table


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> DataFrame:
    """df with slot and shard. The table, of a fixed number of slots, is broadcast; rows are not moved."""
    if {"slot", "shard"} & {c.lower() for c in df.columns}:
        raise ValueError("df has a column named slot or shard")
    spark = df.sparkSession
    names = list(shards)
    lookup = spark.createDataFrame([(i, names[s]) for i, s in enumerate(fill(names, size, weights))], "slot int, shard string")
    return df.withColumn("slot", F.pmod(F.xxhash64(F.col(key)), F.lit(size)).cast("int")).join(F.broadcast(lookup), "slot")
