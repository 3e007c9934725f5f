"""From schedule text to the tariff's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.operators import hierarchy, stored
from stratalex.operators.corpus import Corpus, leaves
from stratalex.sources.sinks import write_tariff
from stratalex.storage import materialise


def metadata(tariff: DataFrame, chapters: DataFrame, title: str, date: str, source: str) -> DataFrame:
    """schemas.METADATA of a built tariff."""
    counts = hierarchy.build_counts(tariff, chapters)
    built = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    values = {"source_title": F.lit(title), "source_date": F.lit(date), "source_file": F.lit(source), "built_at": built, "leaf_count": F.col("leaves").cast("string"), "chapter_count": F.col("chapters").cast("string")}
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()))
    return counts.select(F.explode(pairs).alias("x")).select("x.*")


def build(schedules: DataFrame, out: str, title: str = "", date: str = "", doc: str = "source_file", chapters: list[str] | None = None) -> DataFrame:
    """schedules(source_file, text), or their lines (source_file, pos, line), of one schedule -> tables and search index in
    `out`; the counters of the schedule as one row.

    chapters: of the tables and the index only these chapters are replaced; what is stored of the others stays.
    """
    tariff = materialise(hierarchy.build_tariff(hierarchy.parse_rows(schedules, doc), doc), "tariff")
    heads = materialise(hierarchy.chapters(schedules, doc), "chapters")
    source = schedules.select(F.first(doc)).first()[0] or ""
    write_tariff(tariff.drop(doc), heads.drop(doc), metadata(tariff, heads, title, date, source), out, chapters)
    stored.write(leaves(tariff), f"{out}/index", chapters)
    return hierarchy.build_counts(tariff, heads)


def load(spark, path: str) -> Corpus:
    """The corpus of tables that build() wrote, with its stored index if there is one."""
    date = spark.read.parquet(f"{path}/metadata").filter("key = 'source_date'").select("value").first()
    # A partition column reads as a number where it looks like one.
    tariff = spark.read.option("inferSchema", "false").parquet(f"{path}/tariff_lines").withColumn("chapter", F.lpad(F.col("chapter").cast("string"), 2, "0"))
    said = date[0] if date else ""
    return stored.StoredCorpus(tariff, said, f"{path}/index") if stored.exists(spark, f"{path}/index") else Corpus(tariff, said)
