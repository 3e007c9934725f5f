"""Greedy containment at the scale of documents: texts in order, without those that equal, contain or lie in one kept before.

Which text is kept depends on which were kept before it, but only among texts of which one contains the other.  These pairs
are found by an index: a text that lies in another shares its rarest GRAM letters with it, so each text is looked up by
these alone.  Then the order is played out on the pairs, round by round: a text with no earlier partner left is kept, and what
it contains or lies in goes.  A round decides everything that does not hang on an open decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.functions.text import norm, squash, strip_chars, valid_description
from stratalex.operators.windows import first_wins
from stratalex.storage import materialise

#: Letters of a gram; a valid description has as many.
GRAM = 3


def contained_pairs(nodes: DataFrame, doc: str, pos: str) -> DataFrame:
    """nodes(doc, pos, n), n distinct within a document -> (doc, low, high): places of texts of which one contains the other."""
    size = F.char_length("n")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), size - (GRAM - 1)), lambda i: F.substring(F.col("n"), i, F.lit(GRAM))))
    grams = materialise(nodes.select(doc, pos, size.alias("size"), F.explode(grams).alias("gram")), "grams")
    held = grams.groupBy(doc, "gram").agg(F.count(F.lit(1)).alias("held"))
    rarest = grams.join(held, [doc, "gram"]).groupBy(doc, pos, "size").agg(F.min(F.struct("held", "gram")).alias("x"))
    rarest = rarest.filter("x.held > 1").select(doc, F.col("x.gram").alias("gram"), F.col(pos).alias("inner"), F.col("size").alias("inner_size"))
    met = materialise(rarest, "rarest").join(grams, [doc, "gram"]).filter("inner_size < size").select(doc, "inner", F.col(pos).alias("outer"))
    for end in ("inner", "outer"):
        met = met.join(nodes.select(doc, F.col(pos).alias(end), F.col("n").alias(f"{end}_n")), [doc, end])
    pairs = met.filter(F.col("outer_n").contains(F.col("inner_n")))
    return pairs.select(doc, F.least("inner", "outer").alias("low"), F.greatest("inner", "outer").alias("high"))


def without_contained(rows: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """rows(doc, pos, text), pos unique in its document -> the rows that stay, text cleaned.  Texts without three letters in
    a row are no descriptions and go."""
    cleaned = rows.select(doc, pos, strip_chars(squash(F.col(text)), " ;").alias(text)).filter(valid_description(F.col(text)))
    nodes = materialise(first_wins(cleaned.withColumn("n", norm(F.col(text))), [doc], [F.col("n")], [pos]), "texts")
    pairs = materialise(contained_pairs(nodes, doc, pos), "pairs")
    gone = None
    while not pairs.isEmpty():
        stays = pairs.select(doc, "low").distinct().join(pairs.select(doc, F.col("high").alias("low")), [doc, "low"], "left_anti")
        goes = materialise(pairs.join(stays, [doc, "low"]).select(doc, "high").distinct(), "goes")
        gone = goes if gone is None else gone.unionByName(goes)
        left = pairs.join(goes, [doc, "high"], "left_anti").join(goes.withColumnRenamed("high", "low"), [doc, "low"], "left_anti")
        pairs = materialise(left.select(doc, "low", "high"), "pairs")
    stay = nodes.select(doc, pos, text)
    return stay if gone is None else stay.join(gone.withColumnRenamed("high", pos), [doc, pos], "left_anti")
