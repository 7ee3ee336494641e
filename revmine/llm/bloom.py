"""Blocked Bloom filters of 64-bit hashes, as small tables of 64-slot words, with DataFrame functions only.

A hash picks one word and up to two slots in it, so a hash is one row on its way to the filter, and rows of
one word are combined before the shuffle. A table has (word, bits), words without a set slot left out: at most
slots / 64 rows of two longs, which is the bound under which it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A filter has SLOTS_A_HASH slots for each hash up to MAX_SLOTS; beyond, it lets more through.
SLOTS_A_HASH, MAX_SLOTS = 16, 1 << 27


def slots_for(n: int, max_slots: int = MAX_SLOTS) -> int:
    slots = 1 << 16
    while slots < SLOTS_A_HASH * n and slots < max_slots:
        slots *= 2
    return max(64, min(slots, max_slots))


def place(hashed: Column, slots: int) -> tuple[Column, Column]:
    """(word, mask of its slots) of a hash."""
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, shift).bitwiseAND(F.lit(63)).cast("int"))
    return hashed.bitwiseAND(F.lit(slots // 64 - 1)), bit(58).bitwiseOR(bit(52))


def hit(hashes: DataFrame, column: str, slots: int) -> DataFrame:
    """The slots that some hash has."""
    word, mask = place(F.col(column), slots)
    return hashes.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))


def hit_twice(hashes: DataFrame, column: str, slots: int) -> DataFrame:
    """The slots that two hashes or more have, equal ones included.

    Or and exclusive or of a word's masks tell the slots hit an even number of times. That is all of them if the hits
    add up to one for each odd slot and two for each even one; in a word with more hits every slot that was hit counts.
    """
    word, mask = place(F.col(column), slots)
    seen = hashes.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("some"), F.bit_xor("mask").alias("odd"), F.sum(F.bit_count("mask")).alias("hits"))
    even = F.col("some").bitwiseXOR(F.col("odd"))
    told = F.col("hits") == F.bit_count("odd") + 2 * F.bit_count(even)
    return seen.select("word", F.when(told, even).otherwise(F.col("some")).alias("bits")).filter("bits <> 0")


def marked(rows: DataFrame, hashed: Column, words: DataFrame, slots: int, name: str) -> DataFrame:
    """rows with a boolean: whether the filter has all slots of the hash."""
    p = common.prefix(rows)
    word, mask = place(hashed, slots)
    side = F.broadcast(words.select(F.col("word").alias(f"{p}word"), F.col("bits").alias(f"{p}bits")))
    met = rows.join(side, word == F.col(f"{p}word"), "left")
    has = F.coalesce(F.col(f"{p}bits").bitwiseAND(mask) == mask, F.lit(False))
    return met.withColumn(name, has).drop(f"{p}word", f"{p}bits")
