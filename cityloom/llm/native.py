"""Look-up tables that stay inside column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot_table(hashes: DataFrame, bits: int) -> DataFrame:
    """One row, one array of 2**bits slots: slot h & (2**bits - 1) holds the hashes h that fall into it, all of them.

    `hashes` has one bigint column of distinct values.
    """
    h = hashes.columns[0]
    mask = (1 << bits) - 1
    held = hashes.groupBy(F.col(h).bitwiseAND(F.lit(mask)).alias("_slot")).agg(F.sort_array(F.collect_set(h)).alias("_h"))
    every = hashes.sparkSession.range(1 << bits).select(F.col("id").alias("_slot"))
    filled = F.struct("_slot", F.coalesce("_h", F.array().cast("array<bigint>")).alias("_h"))
    return every.join(held, "_slot", "left").agg(F.transform(F.array_sort(F.collect_list(filled)), lambda x: x["_h"]).alias("slots"))


def bit_table(hashes: DataFrame, bits: int) -> DataFrame:
    """One row, one array of 2**bits bits in 64-bit words: bit h & (2**bits - 1) is set for each hash h."""
    h = hashes.columns[0]
    mask = (1 << bits) - 1
    place = hashes.select(F.col(h).bitwiseAND(F.lit(mask)).alias("_p"))
    words = place.groupBy(F.shiftright("_p", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p & 63 as int))")).alias("_b"))
    every = hashes.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("_w"))
    return every.join(words, "_w", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", F.coalesce("_b", F.lit(0).cast("bigint")).alias("_b")))), lambda x: x["_b"]).alias("bits"))


def in_slots(table: Column, bits: int, h: Column) -> Column:
    return F.coalesce(F.array_contains(F.get(table, h.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")), h), F.lit(False))


def in_bits(table: Column, bits: int, h: Column) -> Column:
    """False only if h is in no entered hash's place."""
    p = h.bitwiseAND(F.lit((1 << bits) - 1))
    # shiftrightunsigned takes its count from the row, so the bit is tested by a power of two
    return F.call_function("getbit", F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
