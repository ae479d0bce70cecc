"""Sharding by a permutation-filled lookup table (Eisenbud et al. 2016).

Each shard has a preference order of the slots of a table of prime size: an offset and a step, both
from hashes of its name. Shards take turns; at its turn a shard claims its most preferred free
slot. The full table gives every shard nearly the same number of slots, and when a shard comes or
goes few other slots change hands. A document's slot is a hash of its key, its shard one lookup in
the broadcast table, whose size is that of the prime.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import table
from turnmill.llm.registry import query

#: Slots; a prime, a hundred times the shards or more.
SLOTS = 6553
#: Slots that a table may have: what is broadcast has at most so many rows.
MOST_SLOTS = 2_000_003
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """For each slot the number of its shard in sorted order of names."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("Name at least one shard, each once.")
    if slots > MOST_SLOTS or slots < len(shards) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"The number of slots must be a prime, at least the shards and at most {MOST_SLOTS}.")
    names = sorted(shards)
    wish = [_hash(n, "offset") % slots for n in names]
    step = [_hash(n, "skip") % (slots - 1) + 1 if slots > 2 else 1 for n in names]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(names)):
            while owner[wish[i]] >= 0:
                wish[i] = (wish[i] + step[i]) % slots
            owner[wish[i]] = i
            free -= 1
            if not free:
                break
    return owner


def lookup(spark: SparkSession, shards: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """slot, shard: the filled table, `slots` rows."""
    names = sorted(shards)
    listed = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    named = F.split(F.lit("\n".join(names)), "\n")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "i")).select(
        F.col("slot").cast("long").alias("slot"), F.get(named, F.col("i").cast("int")).alias("shard")
    )


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 15 hexadecimal digits of the MD5 of its text, modulo the slots."""
    digits = F.substring(F.md5(key.cast("string").cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots))


def place(docs: DataFrame, shards: tuple[str, ...], slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """docs with the columns slot and shard, all rows and columns kept, nothing shuffled.

    Rows with equal keys go to the same slot, so a key that repeats very often makes its shard
    large: choose a key that is unique. A null key is placed like the empty text. Where docs has
    columns of these names, the new ones replace them. No rows give no rows.
    """
    packed = docs.drop("slot", "shard").select(F.struct("*").alias("row"), slot_of(F.coalesce(F.col(key).cast("string"), F.lit("")), slots).alias("slot"))
    return packed.join(F.broadcast(lookup(docs.sparkSession, shards, slots)), "slot").select("row.*", "slot", "shard")


_TABLE = ",".join(map(str, fill(SHARDS)))
_ORACLE = f"""
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents
)
SELECT doc_id, slot, 'shard-' || lpad(string_split('{_TABLE}', ',')[slot + 1], 2, '0') AS shard FROM d
"""


@query("op8_permutation_table", _ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return place(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)
