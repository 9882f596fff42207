"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: a permutation given by an offset and a skip drawn
from its name. Shards take turns claiming their best free slot until the table is full, so each holds an equal share of the
slots (times its weight), and a changed shard list moves few keys. A record's key hashes to a slot; the table, whose size
is a parameter and not data, is broadcast, so placement takes constant time and no shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots (a prime over a hundred times the shards) and shards of the query.
SLOTS, SHARDS = 65_537, 256
#: Most slots a table may have: what is broadcast has a bound.
MOST_SLOTS = 10_000_019


def is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n**0.5) + 1))


def _draw(name: str, what: str) -> int:
    return int.from_bytes(hashlib.md5(f"{what}|{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> np.ndarray:
    """The shard (its place in the sorted list of names) of each slot. weights: turns a shard takes each round (1)."""
    names = sorted(set(shards))
    if not names:
        raise ValueError("at least one shard is needed")
    if not is_prime(slots) or not len(names) <= slots <= MOST_SLOTS:
        raise ValueError("the number of slots must be a prime, no smaller than the number of shards, and bounded")
    at = [_draw(n, "offset") % slots for n in names]
    skip = [_draw(n, "skip") % (slots - 1) + 1 if slots > 2 else 1 for n in names]
    turns = [max(1, (weights or {}).get(n, 1)) for n in names]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(names)):
            for _ in range(turns[i]):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                owner[at[i]] = i
                free -= 1
                if not free:
                    return np.array(owner, np.int32)
    return np.array(owner, np.int32)


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo the slots; a null key is the text '' after a mark of its own."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(documents: DataFrame, shards: list[str], *, key: str = "doc_id", slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """The rows, all columns, with `slot` and `shard` (columns of those names are replaced).

    Rows with equal keys, null among them, share a slot; nothing else of a row matters. Place by an id that is unique: a
    hot key would be one shard's load by definition. An empty table stays empty.
    """
    names = sorted(set(shards))
    owner = lookup_table(names, slots, weights)
    spark = documents.sparkSession
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame({"slot": np.arange(slots, dtype=np.int64), "shard": np.array(names, object)[owner]}))
    rows = documents.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    columns = [c for c in rows.columns if c != "slot"]
    return rows.join(F.broadcast(table), "slot").select(*columns, "slot", "shard")


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]
