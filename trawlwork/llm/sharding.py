"""Sharding by jump consistent hashing: no table of shards, and one shard more moves only the rows it takes.

Only DataFrame expressions; the texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HALF = (1 << 32) - 1
_MULTIPLIER = 2862933555777941757
#: Jumps tried for every key; keys that need more (about none below a million shards) get the rest in a second pass.
_FIRST_JUMPS = 48
#: Parts of a shard that are numbered side by side.
SLOT_BUCKETS = 1024


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """``key * multiplier + 1`` modulo 2**64 on 32-bit halves, so that no product overflows a long."""
    m_high, m_low = _MULTIPLIER >> 32, _MULTIPLIER & _HALF
    low_part = F.shiftleft(F.shiftright(low, 16).bitwiseAND(0xFFFF) * m_low % (1 << 32) % (1 << 16), 16)
    first = low.bitwiseAND(0xFFFF) * m_low + low_part + 1
    carried = F.shiftright(F.shiftright(low, 16) * m_low, 16)

    def times(a: Column, m: int) -> Column:  # modulo 2**32
        upper = (F.shiftright(a, 16) * m).bitwiseAND(0xFFFF)
        return F.shiftleft(upper, 16) + (a.bitwiseAND(0xFFFF) * m)

    new_high = times(high, m_low) + times(low, m_high) + carried + F.shiftright(first, 32)
    return new_high.bitwiseAND(_HALF), first.bitwiseAND(_HALF)


def _state(shard: Column, ahead: Column, high: Column, low: Column) -> Column:
    return F.named_struct(F.lit("shard"), shard, F.lit("next"), ahead, F.lit("high"), high, F.lit("low"), low)


def _jumps(state: Column, shards: int, times: int) -> Column:
    def jump(s: Column, _: Column) -> Column:
        high, low = _next_state(s["high"], s["low"])
        # floor((b + 1) * 2^31 / ((key >> 33) + 1)), in doubles as published
        ahead = F.floor((s["next"] + 1).cast("double") * (float(1 << 31) / (F.shiftright(high, 1) + 1).cast("double")))
        moved = _state(s["next"], ahead.cast("long"), high, low)
        return F.when(s["next"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), state, jump)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards - 1``, of an integer key (its 64 bits taken as unsigned; null counts as 0)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    state = _state(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.shiftrightunsigned(key, 32), key.bitwiseAND(_HALF))
    # Every jump goes on by one shard at least, so ``shards`` jumps always end; few keys need more than the first ones.
    done = _jumps(state, shards, min(shards, _FIRST_JUMPS))
    if shards > _FIRST_JUMPS:
        done = F.when(done["next"] < shards, _jumps(done, shards, shards - _FIRST_JUMPS)).otherwise(done)
    return done["shard"].cast("int")


def with_shard(rows: DataFrame, shards: int, key: str = "doc_id", column: str = "shard") -> DataFrame:
    """All rows and columns plus ``column`` (a column of that name is replaced). Nothing is shuffled."""
    return rows.withColumn(column, jump_shard(F.col(f"`{key}`"), shards))


def shard_manifest(documents: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: its shard and its place in it.

    ``documents(doc_id, text)`` -> ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``. The law is ``key``:
    id and shard count decide. ``slot`` numbers each shard from 0 without gaps. ``grown_shard`` is the shard with one
    shard more: the old one or the new last one.

    Null text: size 1, crc32 of no bytes. Null id: sharded as 0. Rows that agree in id, size and crc32 are counted
    before the shuffle and get neighbouring slots, so that a row repeated at will is one row of work. Other columns
    of the input are ignored. No rows: no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = (
        digest.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("shard", jump_shard(F.col("doc_id"), shards))
        .withColumn("bucket", F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)) % SLOT_BUCKETS + F.col("text_crc32"), F.lit(SLOT_BUCKETS)))
    )
    # Numbered inside small parts of a shard; the parts' totals (shards x buckets rows) say where each part begins.
    part = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        rows.groupBy("shard", "bucket")
        .agg(F.sum("copies").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    )
    placed = rows.withColumn("ahead", F.sum("copies").over(part) - F.col("copies")).join(begins, ["shard", "bucket"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("begin") + F.col("ahead"), F.col("begin") + F.col("ahead") + F.col("copies") - 1)).alias("slot"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
