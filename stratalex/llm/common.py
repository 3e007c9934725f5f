"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.storage import BATCH_BYTES, cleaning, discard, materialise, shared_dir  # noqa: F401
from stratalex.storage import bound_batches as tune  # noqa: F401

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of df in one, so that no column that is added can clash with them; unpack with select(f"{name}.*")."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As materialise(), dealt by a hash of the key as an exchange would deal it: what is joined by the key later need not
    move.  The table's entry in the catalogue goes as soon as it is read; its files stay."""
    spark = df.sparkSession
    table = f"stratalex_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/stratalex/{name}-{uuid.uuid4().hex}"
    with cleaning(spark):
        df.write.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table)
    out = spark.table(table)
    out._stratalex_path = path
    spark.sql(f"DROP TABLE {table}")
    return out


#: 64-bit words of a bitmap: 8 MB at most, whatever the size of the corpus.
BITMAP_WORDS = 1 << 20


def _slot(h: Column) -> tuple[Column, Column]:
    return F.pmod(h, F.lit(BITMAP_WORDS)).cast("int"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63).cast("long")).cast("int")


def bitmap(keys: DataFrame, h: Column) -> DataFrame:
    """(bitmap_word, bitmap_bits): the hashes h of keys, as a table of at most BITMAP_WORDS rows."""
    word, bit = _slot(h)
    one = keys.select(word.alias("bitmap_word"), bit.alias("bit"))
    return one.groupBy("bitmap_word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bitmap_bits"))


def in_bitmap(df: DataFrame, bits: DataFrame, h: Column, name: str) -> DataFrame:
    """df with a boolean: whether the hash h may be among the bitmap's.  It is never false for one that is, so what it lets
    through is a filter ahead of an exact join, and rows that it keeps back need not move."""
    word, bit = _slot(h)
    marked = df.withColumn("bitmap_word", word).join(F.broadcast(bits), "bitmap_word", "left")  # bounded: see bitmap()
    return marked.withColumn(name, F.coalesce(F.getbit("bitmap_bits", bit) == 1, F.lit(False))).drop("bitmap_word", "bitmap_bits")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Spark's lower() does just that on pure ASCII, and is much faster than translate()."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def whole(text: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
