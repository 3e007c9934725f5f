"""Bitmaps of bounded size ahead of exact joins: rows that they keep back need not move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a bitmap: 8 MB at most, whatever the size of the corpus.
WORDS = 1 << 20


def _slot(h: Column) -> tuple[Column, Column]:
    return F.pmod(h, F.lit(WORDS)).cast("int"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63).cast("long")).cast("int")


def bitmap(keys: DataFrame, h: Column) -> DataFrame:
    """(bitmap_word, bitmap_bits): the hashes h (longs) of keys, as a table of at most WORDS rows."""
    word, bit = _slot(h)
    one = keys.select(word.alias("bitmap_word"), bit.alias("bit"))
    return one.groupBy("bitmap_word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bitmap_bits"))


def may_hold(df: DataFrame, bits: DataFrame, h: Column) -> DataFrame:
    """The rows of df whose hash h may be among the bitmap's: all that are, and few others."""
    word, bit = _slot(h)
    marked = df.withColumn("bitmap_word", word).join(F.broadcast(bits), "bitmap_word")  # bounded: see bitmap()
    return marked.filter(F.getbit("bitmap_bits", bit) == 1).drop("bitmap_word", "bitmap_bits")
