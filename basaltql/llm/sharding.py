"""Sharding by jump consistent hashing (Lamping and Veach, 2014), on DataFrame functions only.

``jump_shard`` maps a 64-bit key to one of n shards without a ring table. When shards are
appended, a key either keeps its shard or moves into a new one, so that only the necessary
fraction of the rows moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltql.llm.common import positions, written

# Fixed values of the published algorithm.
_MULTIPLIER = "2862933555777941757"
_TWO_64 = "18446744073709551616"
_WIDE = "decimal(38,0)"


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a long ``key`` (null counts as key 0).

    The 64-bit product needs up to 126 bits and so is taken in decimal(38,0), which is exact and
    does not trip over ANSI overflow. Each step raises the bucket, hence ``shards`` steps suffice.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    unsigned = F.coalesce(key.cast("long"), F.lit(0)).cast(_WIDE)
    unsigned = F.when(unsigned < 0, unsigned + F.lit(_TWO_64).cast(_WIDE)).otherwise(unsigned).cast(_WIDE)
    start = F.struct(unsigned.alias("k"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(state: Column, _: Column) -> Column:
        grown = (state["k"] * F.lit(_MULTIPLIER).cast("decimal(19,0)")).cast(_WIDE) + F.lit(1)
        k = (grown.cast(_WIDE) % F.lit(_TWO_64).cast(_WIDE)).cast(_WIDE)
        draw = F.floor(k / F.lit(1 << 33)).cast("double") + F.lit(1.0)
        leap = F.floor((state["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / draw)).cast("long")
        moved = F.struct(k.alias("k"), state["j"].alias("b"), leap.alias("j"))
        return F.when(state["j"] < shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes plus 1 (null text: 1, crc32 of no bytes). ``slot`` counts each shard's rows
    from 0 in key order; repeated rows get slots of their own. A null key is sharded like key 0.
    Only the two named columns are read; an empty table gives no rows. The texts are read once and
    only narrow rows are shuffled, range-dealt by (shard, key) so that no shard is one task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    placed = positions(written(narrow, "sizes"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
