"""A search index that a build stores and that sessions share.

Tables lie under one path, partitioned by chapter, so that a rebuilt chapter replaces its partitions and no other; within a
chapter they are bucketed by what they are looked up by and sorted within the bucket.  A lookup moves what is asked for to
the buckets; postings, counts and terms stay where they lie.

leaves (by code): the declarable lines with their token sets; postings (token, code); words (token, df); terms (stem, code, tf,
length); sizes: leaves, lines with words, and words of each chapter.  Counts are per chapter and added up when they are read,
bucket by bucket.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.functions.similarity import porter_udf
from stratalex.operators import index
from stratalex.operators.corpus import Corpus
from stratalex.storage import materialise

#: Buckets of a chapter's tables.
BUCKETS = 8
#: Columns of each table but the chapter, and the one that buckets it (none: a row per chapter).
TABLES = {
    "leaves": ("hs_code string, heading string, description string, legal_path string, search_text string, duty_general string, tokens array<string>, specific array<string>, nearest array<string>", "hs_code"),
    "postings": ("token string, hs_code string", "token"),
    "words": ("token string, df long", "token"),
    "terms": ("term string, hs_code string, tf long, length int", "term"),
    "sizes": ("leaves long, with_terms long, length long", None),
}


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _fs(spark, path)
    return files.exists(place)


def table(spark: SparkSession, path: str, kind: str, buckets: int = BUCKETS) -> str:
    """The name of a stored table in this session's catalogue, entered there at first use.  Its files belong to the path."""
    name = f"stratalex_{kind}_{hashlib.md5(path.encode()).hexdigest()[:12]}"
    if not spark.catalog.tableExists(name):
        columns, key = TABLES[kind]
        by = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS" if key else ""
        place = f"{path}/{kind}".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}, chapter string) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY (chapter) {by} LOCATION '{place}'")
        if exists(spark, f"{path}/{kind}"):
            spark.sql(f"MSCK REPAIR TABLE {name}")
    return name


def _tables(leaves: DataFrame) -> dict[str, DataFrame]:
    """The tables of leaves, as corpus.leaves() gives them."""
    posted = leaves.select(F.explode(F.array_distinct("tokens")).alias("token"), "hs_code", "chapter")
    said = F.regexp_extract_all(F.lower("search_text"), F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0))
    stems = materialise(leaves.select("hs_code", "chapter", porter_udf(said).alias("stems")), "stems")
    terms = stems.select("hs_code", "chapter", F.size("stems").alias("length"), F.explode("stems").alias("term")).groupBy("term", "hs_code", "length", "chapter").agg(F.count(F.lit(1)).alias("tf"))
    length = F.size("stems")
    sizes = stems.groupBy("chapter").agg(F.count(F.lit(1)).alias("leaves"), F.count_if(length > 0).alias("with_terms"), F.sum(length).cast("long").alias("length"))
    return {"leaves": leaves, "postings": posted, "words": posted.groupBy("token", "chapter").agg(F.count(F.lit(1)).alias("df")), "terms": terms, "sizes": sizes}


def write(leaves: DataFrame, path: str, chapters: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """Store the index of leaves (corpus.leaves()) under path.

    chapters: only these are replaced, by what leaves has of them; a chapter of which it has nothing goes.  None: all of them.
    Each table of each chapter is replaced as a whole; a write that broke off is mended by the next one.
    """
    spark = leaves.sparkSession
    leaves = materialise(leaves if chapters is None else leaves.filter(F.col("chapter").isin(chapters)), "indexed")
    there = {r[0] for r in leaves.select("chapter").distinct().collect()}  # a tariff has 99 chapters at most
    for kind, rows in _tables(leaves).items():
        name, key = table(spark, path, kind, buckets), TABLES[kind][1]
        columns = spark.table(name).columns
        held = {r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
        dealt = rows.repartition(buckets, key) if key else rows.coalesce(1)
        dealt.select(*columns).write.mode("overwrite").insertInto(name)
        for gone in sorted((held if chapters is None else held & set(chapters)) - there):
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (chapter = '{gone}')")
            files, place = _fs(spark, f"{path}/{kind}/chapter={gone}")
            files.delete(place, True)
        spark.catalog.refreshTable(name)


@dataclass(frozen=True)
class StoredCorpus(Corpus):
    """A corpus whose search index is read from where write() has put it; nothing is tokenised or counted anew."""

    path: str = ""
    buckets: int = BUCKETS

    def _table(self, kind: str) -> DataFrame:
        spark = self.tariff.sparkSession
        return spark.table(table(spark, self.path, kind, self.buckets))

    @cached_property
    def leaves(self) -> DataFrame:
        return self._table("leaves")

    @cached_property
    def _sizes(self) -> tuple[int, int, int]:
        return tuple(x or 0 for x in self._table("sizes").agg(F.sum("leaves"), F.sum("with_terms"), F.sum("length")).first())

    @cached_property
    def leaf_count(self) -> int:
        return self._sizes[0]

    @cached_property
    def postings(self) -> DataFrame:
        return self._table("postings").select("token", "hs_code")

    @cached_property
    def weights(self) -> DataFrame:
        return index.with_idf(self._table("words").groupBy("token").agg(F.sum("df").alias("df")), self.leaf_count)

    @cached_property
    def terms(self) -> DataFrame:
        return self._table("terms").drop("chapter")

    @cached_property
    def mean_terms(self) -> float:
        return float(self._sizes[2] / self._sizes[1]) if self._sizes[1] else 1.0
