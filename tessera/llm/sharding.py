"""Sharding by a permutation-filled lookup table.

Every shard has its own order of all slots of a table of prime size: offset + k * skip, from two hashes of its name.
The shards take turns; at each turn a shard claims the first slot in its order that is still free (a shard of weight
w has w turns in a round). Sizes differ by at most one slot per turn, and adding or removing a shard moves few slots.
A row's slot is the hash of its key modulo the table's size, so that placing a row is one lookup in a broadcast
table, whose size is a parameter and doesn't grow with the data.

Defined results: rows whose key columns are all null go by the hash of nulls, all to one shard; equal keys go to the
same shard; an empty table gives an empty result; other columns stay as they are, but for columns that are called slot or shard
already, which become slot_0 and shard_0 (or the next free number); they may be the key.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import set_aside

SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> np.ndarray:
    """The shard's index in every slot."""
    if not is_prime(slots) or slots < len(shards) or not shards or len(set(shards)) < len(shards):
        raise ValueError("slots must be a prime, at least the number of shards, and shards distinct")
    turns = weights or [1] * len(shards)
    if any(t < 1 for t in turns):
        raise ValueError("weights must be positive integers")
    order = []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        order.append(((offset + skip * np.arange(slots, dtype=np.int64)) % slots).tolist())
    owner, at, filled = [-1] * slots, [0] * len(shards), 0
    while True:
        for i, mine in enumerate(order):
            for _ in range(turns[i]):
                k = at[i]
                while owner[mine[k]] >= 0:
                    k += 1
                owner[mine[k]], at[i], filled = i, k + 1, filled + 1
                if filled == slots:
                    return np.array(owner, np.int32)


def assign(df: DataFrame, shards: list[str], key: str | list[str] = "doc_id", slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """df with slot and shard. A row's hash is the first 60 bits of the MD5 of its keys as texts, nulls as such."""
    keys = [key] if isinstance(key, str) else key
    owner = table(shards, slots, weights)
    told = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(owner.tolist())], "__tessera_slot long, __tessera_shard string")
    named = F.concat_ws("\x01", *(F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys))
    slot = F.pmod(F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots).cast("long"))
    placed = set_aside(df.withColumn("__tessera_slot", slot), "slot", "shard").join(F.broadcast(told), "__tessera_slot")
    return placed.withColumnsRenamed({"__tessera_slot": "slot", "__tessera_shard": "shard"}).select(*(c for c in placed.columns if not c.startswith("__tessera_")), "slot", "shard")


def write(df: DataFrame, path: str, shards: list[str], key: str | list[str] = "doc_id", **more) -> None:
    """One folder per shard under path, the rows of each spread over as many files as its tasks wrote."""
    assign(df, shards, key, **more).drop("slot").write.partitionBy("shard").parquet(path)


NAMES = [f"shard-{i:03d}" for i in range(256)]


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read

    return assign(read(spark, sf_dir, "documents").select("doc_id"), NAMES)


def sql() -> str:
    """The slot by DuckDB's own MD5; the owner of each slot, by the definition of the table, as a list."""
    owner = ",".join(map(str, table(NAMES).tolist()))
    return f"""with t as (select string_split('{owner}', ',') as owner),
    d as (select doc_id, ('0x' || substr(md5(coalesce('=' || doc_id, '')), 1, 15))::bigint % {SLOTS} as slot from documents)
    select doc_id, slot, 'shard-' || lpad(owner[slot + 1], 3, '0') as shard from d, t"""
