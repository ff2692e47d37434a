"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups in which the slots of a shard are numbered; fixed, so slots do not depend on the table's size.
SALTS = 4096


# The published generator's multiplier, and the bits of its draws.
MULTIPLIER, DRAW_BITS = 2862933555777941757, 31
LIMB = 22


def _limbs(value: int) -> list[int]:
    return [value >> (LIMB * i) & (1 << LIMB) - 1 for i in range(3)]


def next_key(key: Column) -> Column:
    """``key * MULTIPLIER + 1`` modulo 2 ** 64 as a long, in limbs of LIMB bits, as ANSI SQL refuses a product that wraps."""
    mask = (1 << LIMB) - 1
    a = [F.shiftrightunsigned(key, LIMB * i).bitwiseAND(mask) for i in range(3)]
    b = _limbs(MULTIPLIER)
    low = a[0] * b[0] + 1
    middle = a[0] * b[1] + a[1] * b[0] + F.shiftright(low, LIMB)
    high = a[0] * b[2] + a[1] * b[1] + a[2] * b[0] + F.shiftright(middle, LIMB)
    return F.shiftleft(high, 2 * LIMB).bitwiseOR(F.shiftleft(middle.bitwiseAND(mask), LIMB)).bitwiseOR(low.bitwiseAND(mask))


def key_of(docs: DataFrame, id_col: str) -> Column:
    """The 64-bit key of an id: a whole number itself, else a hash; null is a key like others."""
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    hashed = F.xxhash64(id_col)
    return F.coalesce(F.col(id_col).cast("long"), hashed) if whole else hashed


def jump_shards(key: Column, shards: int) -> Column:
    """Jump consistent hash of a long ``key``: struct of ``shard`` in ``0 .. shards - 1`` and ``grown`` with one shard more.

    The published algorithm: the key is the state of a linear generator; from bucket b it
    jumps to ``floor((b + 1) / r)``, r being the next draw in (0, 1]; the last bucket below
    ``shards`` is the result.  Adding a shard therefore moves a key only into the new one,
    with chance 1 / (shards + 1), and no ring table is kept.  The jump that leaves the
    shards tells where the key goes when there is one more.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(state: Column, _: Column) -> Column:
        drawn = F.struct(next_key(state["key"]).alias("key"), state["next"].alias("b"))
        ahead = lambda s: F.floor((s["b"] + 1) * (F.lit(float(1 << DRAW_BITS)) / (F.shiftrightunsigned(s["key"], 64 - DRAW_BITS) + 1).cast("double"))).cast("long")
        moved = F.element_at(F.transform(F.array(drawn), lambda s: F.struct(s["key"].alias("key"), s["b"].alias("at"), ahead(s).alias("next"))), 1)
        return F.when(state["next"] < shards, moved).otherwise(state)

    def finish(state: Column) -> Column:
        shard = state["at"].cast("int")
        return F.struct(shard.alias("shard"), F.when(state["next"] == shards, F.lit(shards)).otherwise(shard).alias("grown"))

    start = F.struct(key.alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, finish)


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, gapless slot and grown shard of every row.

    Returns id, size (UTF-8 bytes + 16), text_crc32, shard, slot, grown_shard.  Slots
    count from 0 in each shard.  They are numbered inside small groups (shard, salt of
    the id) and shifted by the rows of the groups before, so no task gets a whole
    shard; the table of groups has shards * SALTS rows at most and is broadcast.  Null
    text: 0 bytes, CRC 0.  Null id: one key like others; repeated rows all keep a slot of
    their own.  Rows of one id are one group, as the law puts them into one shard.  An
    empty table gives no rows.  Other columns are not carried; texts of any length count.
    """
    key, jump_key = F.col(id_col), key_of(docs, id_col)
    salt = F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(SALTS)).cast("int").alias("_salt")
    rows = docs.select(
        key.alias(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        jump_shards(jump_key, shards).alias("_jump"), salt,
    ).select(id_col, "size", "text_crc32", F.col("_jump.shard").alias("shard"), F.col("_jump.grown").alias("grown_shard"), "_salt")
    groups = docs.select(jump_shards(jump_key, shards)["shard"].alias("shard"), salt).groupBy("shard", "_salt").count()
    before = Window.partitionBy("shard").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("shard", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_salt").orderBy(id_col, "text_crc32", "size")
    numbered = rows.withColumn("_n", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "_salt"]).select(
        id_col, "size", "text_crc32", "shard", (F.col("_start") + F.col("_n")).alias("slot"), "grown_shard"
    )
