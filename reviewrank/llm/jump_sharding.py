"""Shards by jump consistent hashing, with built-in functions only.

The key seeds a 64-bit linear congruential generator; its draws say at which shard counts the row jumps to the newest
shard.  No ring table is needed, and one more shard takes about 1/(n+1) of the rows and moves no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewrank.functions.prefix import Ordered
from reviewrank.llm.common import own_columns

SHARDS = 24
# fixed values of the method: the generator's multiplier 2862933555777941757 in pieces of 32, 16 and 16 bits
MULTIPLIER_HIGH, MULTIPLIER_MIDDLE, MULTIPLIER_LOW = 0x27BB2EE6, 0x87B0, 0xB0FD
_LOW_32, _LOW_16 = 0xFFFFFFFF, 0xFFFF


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _draw(state: Column) -> Column:
    """The next generator state and jump.  64-bit products are built from halves, as whole ones would overflow."""
    high, low, at = state["high"], state["low"], state["next"]
    p0, p1 = low * _long(MULTIPLIER_LOW), low * _long(MULTIPLIER_MIDDLE)
    sum_low = p0 + F.shiftleft(p1.bitwiseAND(_long(_LOW_16)), 16) + 1
    carry = F.shiftright(sum_low, 32) + F.shiftright(p1, 16)
    from_high = high * _long(MULTIPLIER_LOW) + F.shiftleft((high * _long(MULTIPLIER_MIDDLE)).bitwiseAND(_long(_LOW_16)), 16)
    new_high = (carry + low * _long(MULTIPLIER_HIGH) + from_high).bitwiseAND(_long(_LOW_32))
    jump = F.floor((at + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(new_high, 1) + 1).cast("double")))
    return F.struct(
        new_high.alias("high"), sum_low.bitwiseAND(_long(_LOW_32)).alias("low"), at.alias("shard"), jump.cast("long").alias("next")
    )


def jump_hash(key: Column, shards: int) -> Column:
    """``struct(shard, grown)``: the shard of ``key`` (long; null: 0) among ``shards``, and among one more."""
    key = F.coalesce(key, _long(0))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(_long(_LOW_32)).alias("low"), _long(-1).alias("shard"), _long(0).alias("next")
    )
    # every draw jumps to a higher shard, so there are at most `shards` of them
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)), start, lambda s, _: F.when(s["next"] < shards, _draw(s)).otherwise(s),
        lambda s: F.struct(s["shard"].cast("int").alias("shard"), F.when(s["next"] == shards, shards).otherwise(s["shard"]).cast("int").alias("grown")),
    )
    return end


def key_of(df: DataFrame, name: str) -> Column:
    """Whole numbers are their own key; anything else is hashed."""
    whole = dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint")
    return F.col(name).cast("long") if whole else F.xxhash64(F.col(name))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``.

    ``shard`` follows from ``doc_id`` and ``shards`` alone (law ``key``); ``slot`` numbers the rows of a shard from 0
    in the order of ``doc_id``, equal ids by checksum.  ``size`` is the text's UTF-8 bytes (null: none) plus 8; the checksum of a null
    text is that of an empty one.  A null ``doc_id`` has key 0; repeated rows get slots of their own.  Slots come from running
    counts over range partitions: neither a shard nor a repeated id is gathered in one task.
    """
    text = F.coalesce("text", F.lit(""))
    dealt = own_columns(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(key_of(docs, "doc_id"), shards).alias("to"),
        F.monotonically_increasing_id().alias("tie"),
    )
    dealt = dealt.select("doc_id", "size", "text_crc32", "law", "to.shard", F.col("to.grown").alias("grown_shard"), "tie")
    placed = Ordered(dealt, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("tie")]).running(sums={"upto": F.lit(1)})
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("upto") - 1).cast("long").alias("slot"), "grown_shard")
