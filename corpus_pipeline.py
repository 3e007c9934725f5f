"""A training-data pipeline over documents: quality, exact duplicates, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next
stage's docs.  All stages but the last return the columns of documents.

In every stage a null text counts as empty, texts of any length are read whole, null and repeated ids are rows like others,
an empty table gives an empty result, and further columns, whatever their names, come along as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.llm import bpe, exact_dedup, mixing, quality, simhash
from stratalex.llm.common import bitmap, in_bitmap, materialise, packed, read
from stratalex.llm.queries import vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, trained on labels, finds good; all, where labels teach nothing."""
    return quality.scored_rows(docs, read(spark, sf_dir, "labels")).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, A-Z in lower case: that of the largest id; of rows that repeat it, any one."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that links of verified similarity (five-word Jaccard >= 0.8) join.

    Rows with a null id stay, and so does an id that different texts share if one of them stands for its group.
    """
    found = materialise(simhash.verified_duplicates(docs), "near")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = found.filter(~stays).select("doc_id").distinct().join(found.filter(stays).select("doc_id"), "doc_id", "left_anti")
    # Few documents go; the others need not move for it.
    gone = materialise(gone, "gone")
    rows = docs.select(packed(docs), "doc_id")
    rows = in_bitmap(rows, bitmap(gone, F.xxhash64("doc_id")), F.xxhash64("doc_id"), "suspect")
    stay = rows.filter(~F.col("suspect")).unionByName(rows.filter("suspect").join(gone, "doc_id", "left_anti"))
    return stay.select("row.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it; rows that repeat id, source and text are one document."""
    return mixing.take(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of token ids, and the digests of the ids and of their decoding, of each document."""
    return bpe.encode_decode(docs, vocabulary_path(), with_texts=False)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("mixing", mix_stage),
    ("bpe", token_stage),
]

#: The classifier and the fingerprints are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
