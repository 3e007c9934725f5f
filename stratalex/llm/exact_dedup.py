"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Each pass reads the table anew; only narrow rows move between executors.  Of the (length, head) groups that survive, a
bitmap goes to the executors, so whole texts are hashed only where a row may belong to one.  The bitmap has a proven bound
(common.BITMAP_WORDS rows, 8 MB) whatever the corpus' size.  It is a filter ahead of the hash alone: which rows are equal is
decided by the whole hash, so in a corpus with more surviving groups than bits more rows are hashed and none is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import ascii_lower, bitmap, in_bitmap, materialise, packed, whole

#: Code points of the beginning that the second pass hashes.
HEAD = 256

def _sized(docs: DataFrame, text_col: str) -> tuple[Column, Column]:
    text = whole(text_col)
    return F.octet_length(text).alias("n_bytes"), F.xxhash64(ascii_lower(F.substring(text, 1, HEAD))).alias("head")


def surviving_heads(docs: DataFrame, text_col: str) -> DataFrame:
    """The bitmap of the (length, head) groups that hold several rows."""
    n_bytes, head = _sized(docs, text_col)
    lengths = docs.groupBy(n_bytes).count().filter("count > 1").select("n_bytes")  # one row per length that occurs twice
    lengths = materialise(lengths, "lengths")  # read anew, so that the join can split a length that is everywhere
    heads = docs.select(n_bytes, head).join(lengths, "n_bytes", "left_semi").groupBy("n_bytes", "head").count().filter("count > 1")
    return materialise(bitmap(heads, F.xxhash64("n_bytes", "head")), "heads")  # read twice


def _marked(docs: DataFrame, bits: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    """columns of docs with whole_text, n_bytes and candidate: whether the row may have equals."""
    n_bytes, head = _sized(docs, text_col)
    rows = docs.select(*columns, whole(text_col).alias("whole_text"), n_bytes, head)
    return in_bitmap(rows, bits, F.xxhash64("n_bytes", "head"), "candidate")


def _hash() -> Column:
    return F.sha2(ascii_lower(F.col("whole_text")), 256)


def digest_rows(docs: DataFrame, bits: DataFrame, id_col: str, text_col: str, digest_all: bool) -> DataFrame:
    """(id, n_bytes, candidate, text_sha256): the whole text's SHA-256 where the row may have equals, or everywhere."""
    rows = _marked(docs, bits, text_col, F.col(id_col).alias("id"))
    return rows.select("id", "n_bytes", "candidate", (_hash() if digest_all else F.when(F.col("candidate"), _hash())).alias("text_sha256"))


def _groups(rows: DataFrame) -> DataFrame:
    """(n_bytes, text_sha256, group_size, keep_id, ties) of the texts that several rows share; ties: rows with keep_id."""
    same = ["n_bytes", "text_sha256"]
    # One row per text and id first: a large group of copies arrives as partial counts, never as rows.
    by_id = rows.filter("candidate").groupBy(*same, "id").agg(F.count(F.lit(1)).alias("n"))
    top = F.max_by(F.struct(F.col("id").alias("keep_id"), F.col("n").alias("ties")), F.struct(F.col("id").isNotNull(), F.col("id")))
    groups = by_id.groupBy(*same).agg(F.sum("n").alias("group_size"), top.alias("top")).filter("group_size > 1").select(*same, "group_size", "top.*")
    return materialise(groups, "groups")  # read anew, so that the join can split a large group of copies


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty.  The row with the largest id stays
    (null ids are least).  Of rows that repeat both id and text one stays, no matter which.  text_sha256 is null for rows
    that the first two passes told apart, unless digest_all.  Other columns are ignored.
    """
    rows = materialise(digest_rows(docs, surviving_heads(docs, text_col), id_col, text_col, digest_all).withColumn("row", F.monotonically_increasing_id()), "digests")
    groups = _groups(rows)
    joined = rows.join(groups, ["n_bytes", "text_sha256"], "left")
    alone, mine = F.col("group_size").isNull(), F.col("id").eqNullSafe(F.col("keep_id"))
    # Of rows that repeat an id and a text the first stays.
    tied = groups.filter("ties > 1").select("n_bytes", "text_sha256", "keep_id")
    first = rows.join(tied, ["n_bytes", "text_sha256"]).filter(mine).groupBy("n_bytes", "text_sha256").agg(F.min("row").alias("first"))
    first = materialise(first, "first")
    joined = joined.join(first, ["n_bytes", "text_sha256"], "left")
    kept = alone | (mine & (F.col("first").isNull() | (F.col("row") == F.col("first"))))
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names: of each text one row, that of the largest
    id (null ids are least, a null text counts as empty); of rows that repeat an id and a text one stays, no matter which.

    Rows that the first two passes told apart stay where they are; those that may have equals move once, with their
    texts, unless the groups are few enough for a broadcast.  An empty table gives an empty result.
    """
    bits = surviving_heads(docs, text_col)
    groups = _groups(digest_rows(docs, bits, id_col, text_col, False))
    groups = groups.select("text_sha256", F.lit(True).alias("grouped"), "keep_id", "ties").hint("merge")  # grows with the corpus
    rows = _marked(docs, bits, text_col, packed(docs), F.col(id_col).alias("id"))
    alone = rows.filter(~F.col("candidate")).select("row.*")
    met = rows.filter("candidate").select("row", "id", _hash().alias("text_sha256")).join(groups, "text_sha256", "left")
    met = met.filter(F.col("grouped").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    tied = groups.filter("ties > 1")
    if tied.isEmpty():
        return alone.unionByName(met.select("row.*"))
    repeats = met.filter("ties > 1").groupBy("text_sha256").agg(F.first("row").alias("row"))  # combined before they move
    return alone.unionByName(met.filter("ties is null or ties = 1").select("row.*")).unionByName(repeats.select("row.*"))
