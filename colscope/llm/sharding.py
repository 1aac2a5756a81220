"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in native expressions.

A stable key walks through increasing shard numbers; the walk does not depend on
how many shards there are, so appending a shard moves into it exactly the rows
whose walk lands there and no other row.  No ring table, no state, no Python:
the 64-bit generator of the paper runs on two 32-bit halves in BIGINT columns, which
never overflow (ANSI mode stays on).

Defined results: a NULL key is hashed like the empty string; a NULL text has size
16 and checksum 0; rows that are equal in key, size and checksum get neighbouring slots;
an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colscope.session import reliable_checkpoint

#: Multiplier and increment of the paper's generator.
MULTIPLIER = 2862933555777941757
INCREMENT = 1

_LOW = 0xFFFFFFFF
_HALF = 0xFFFF
#: Steps of the first walk; rows that need more (one in many millions) go on to the end.
_FIRST_STEPS = 64
#: Aimed rows per (shard, bucket) when slots are dealt.
SLOT_ROWS = 50_000


def key_halves(key: Column) -> tuple[Column, Column]:
    """Upper and lower 32 bits of a 64-bit hash of the key's text (NULL: empty)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def _step(s: Column) -> Column:
    """One draw of the generator and the jump that it decides."""
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & _LOW
    m1, m0 = m_low >> 16, m_low & _HALF
    hi, lo = s["hi"], s["lo"]
    low_part = lo * m0 + F.lit(INCREMENT)
    mid_part = lo * m1 + F.shiftright(low_part, 16)
    new_lo = F.shiftleft(mid_part.bitwiseAND(F.lit(_HALF)), 16) + low_part.bitwiseAND(F.lit(_HALF))
    new_hi = (F.shiftright(mid_part, 16) + hi * m0 + F.shiftleft((hi * m1).bitwiseAND(F.lit(_HALF)), 16)
              + lo * m_high).bitwiseAND(F.lit(_LOW))
    draw = (F.shiftright(new_hi, 1) + 1).cast("double")
    jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw))
    return F.struct(new_hi.alias("hi"), new_lo.alias("lo"), s["j"].alias("b"), jump.alias("j"))


def _walk(state: Column, shards: int, steps: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state,
                       lambda s, _: F.when(s["j"] >= shards, s).otherwise(_step(s)))


def jump_state(hi: Column, lo: Column, shards: int) -> Column:
    """Struct with ``b``, the shard of the key, and ``j``, the shard that it would jump to next."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    state = _walk(start, shards, min(shards, _FIRST_STEPS))
    if shards > _FIRST_STEPS:
        state = F.when(state["j"] >= shards, state).otherwise(_walk(state, shards, shards))
    return state


def assign_shards(df: DataFrame, key: str, shards: int, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """``df`` with the row's shard out of ``shards`` and its shard if one more were appended."""
    if {shard, grown} & set(df.columns):
        raise ValueError(f"the columns {shard}, {grown} must not exist yet")
    # The hash and the walk are columns of their own selects, so each is evaluated once a row.
    halves = F.struct(*(c.alias(n) for c, n in zip(key_halves(F.col(f"r.`{key}`")), ("hi", "lo"))))
    rows = df.select(F.struct("*").alias("r")).select("r", halves.alias("h"))
    rows = rows.select("r", jump_state(F.col("h.hi"), F.col("h.lo"), shards).alias("w"))
    return rows.select("r.*", F.col("w.b").cast("int").alias(shard),
                       F.when(F.col("w.j") == shards, F.lit(shards)).otherwise(F.col("w.b")).cast("int").alias(grown))


def assign_slots(rows: DataFrame, keys: list[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Gapless positions from 0 in every shard, in the order of a hash of ``keys`` and then ``keys``.

    Equal rows are counted before the shuffle and expanded after it, and a shard is
    split into hash ranges whose number follows the row count, so neither a hot key
    nor a large shard becomes one task's window.  The order does not depend on the number of ranges.
    """
    columns = rows.columns
    mark = F.md5(F.concat_ws(":", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in keys)))
    counted = reliable_checkpoint(
        rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_mark", F.conv(F.substring(mark, 1, 8), 16, 10).cast("long")))
    bits = min(31, max(0, math.ceil(math.log2(max(1, counted.count()) / SLOT_ROWS))))
    dealt = counted.withColumn("_range", F.shiftright(F.col("_mark"), 32 - bits) if bits else F.lit(0).cast("long"))
    sums = dealt.groupBy(shard, "_range").agg(F.sum("_n").alias("_sum"))
    before = W.partitionBy(shard).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(shard, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(shard, "_range").orderBy("_mark", *keys).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return (placed.join(offsets, [shard, "_range"])
            .select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_copy"),
                    (F.col("_offset") + F.col("_before")).alias("_first"))
            .select(*columns, (F.col("_first") + F.col("_copy")).alias(slot)))


def write_shards(df: DataFrame, key: str, shards: int, path: str, files_per_shard: int = 1) -> None:
    """Write the rows below ``path``/shard=N; ``files_per_shard`` bounds the files and the tasks of one shard."""
    dealt = assign_shards(df, key, shards).drop("grown_shard")
    part = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_shard))
    dealt.repartition("shard", part).write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's table for ``docs``: size, checksum, law, shard, slot and the shard after growth."""
    body = F.col(text).cast("string")
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"),
                         (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("long").alias("size"),
                         F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"))
    placed = assign_slots(assign_shards(narrow, "doc_id", shards), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
