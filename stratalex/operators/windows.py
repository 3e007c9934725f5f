"""Ordered operators within a document: fill-down, numbering, first-wins deduplication, precedence, greedy containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratalex.functions.text import norm, squash, strip_chars, valid_description
from stratalex.storage import materialise

DITTO_MARK = '"'


def fill_dittos(df: DataFrame, doc: list[str], order: list[str], code: str = "noted_code", flag: str = "same_as_above") -> DataFrame:
    """A ditto mark takes the last code above it (null without one) and sets the flag; blanks stay blank."""
    above = W.partitionBy(*doc).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    is_ditto = F.coalesce(F.col(code) == DITTO_MARK, F.lit(False))
    explicit = F.last(F.when(~is_ditto & (F.col(code) != ""), F.col(code)), ignorenulls=True).over(above)
    return df.withColumns({flag: is_ditto, code: F.when(is_ditto, explicit).otherwise(F.col(code))})


def number_lines(df: DataFrame, doc: list[str], order: list[str], name: str = "line_number") -> DataFrame:
    """1, 2, ... within each document."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*doc).orderBy(*order)))


def number_all(df: DataFrame, doc: str, order: str, name: str = "line_number") -> DataFrame:
    """1, 2, ... over all documents in the order of doc, then of order.

    Rows are dealt by ranges and sorted within them; each is numbered within its range and moved by the rows of the ranges
    before it.  Only one count per range meets in one place, however many documents or rows there are.
    """
    ranged = df.repartitionByRange(doc, order).sortWithinPartitions(doc, order)
    at = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")  # range << 33, plus the place in it
    counts = at.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    moved = at.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_range"))  # a row per range of a shuffle
    return moved.withColumn(name, F.col("_before") + place + 1).drop("_at", "_range", "_before")


def first_wins(df: DataFrame, doc: list[str], keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key within a document."""
    w = W.partitionBy(*doc, *keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def by_precedence(df: DataFrame, doc: list[str], priority: str) -> DataFrame:
    """Of each document the rows of the least priority that it has."""
    return df.withColumn("_least", F.min(priority).over(W.partitionBy(*doc))).filter(F.col(priority) == F.col("_least")).drop("_least")


def greedy_containment(texts: Column) -> Column:
    """Texts in order, without those that equal, contain or lie in one kept before (by normalised form).  The fold
    depends on its order, so it runs over one document's texts."""
    cleaned = F.filter(F.transform(texts, lambda t: strip_chars(squash(t), " ;")), valid_description)

    def step(kept: Column, text: Column) -> Column:
        n = norm(text)
        return F.when(F.exists(kept, lambda k: norm(k).contains(n) | n.contains(norm(k))), kept).otherwise(F.array_append(kept, text))

    return F.aggregate(cleaned, F.array().cast("array<string>"), step)
