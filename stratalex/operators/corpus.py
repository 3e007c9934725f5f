"""The tariff corpus: leaves with their token sets, heading wording, wording by digit prefix, and the search index.

A tariff has some ten thousand lines, but nothing here relies on that: lookups are plain equi-joins, which adaptive
execution turns into broadcasts while the sides are small.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.functions.similarity import porter_udf
from stratalex.functions.text import format_heading, nearest_tokens, schedule_date, squash, token_set
from stratalex.operators import index
from stratalex.storage import materialise


def leaves(tariff: DataFrame) -> DataFrame:
    """Declarable lines with token sets."""
    d = F.coalesce("description", F.lit(""))
    path = F.coalesce(F.when(F.col("legal_path") != "", F.col("legal_path")), d)
    search = F.coalesce(F.when(F.col("search_text") != "", F.col("search_text")), d)
    df = tariff.filter(F.col("is_leaf") & F.col("hs_code").isNotNull())
    df = df.select("hs_code", "heading", "chapter", d.alias("description"), path.alias("legal_path"), search.alias("search_text"), F.coalesce(F.when(F.col("duty_general") != "", F.col("duty_general")), F.lit("Unknown")).alias("duty_general"))
    return df.select("*", token_set(F.col("search_text")).alias("tokens"), token_set(F.col("description")).alias("specific"), nearest_tokens(F.col("legal_path")).alias("nearest"))


def heading_text(tariff: DataFrame, key: str = "heading", code: str = "digits", text: str = "description", id_col: str = "id") -> DataFrame:
    """(heading, heading_text): the first wording by length of the digits, digits and id that is not just Other."""
    said = F.trim(text)
    usable = tariff.filter((F.col(text) != "") & (F.regexp_replace(F.lower(said), ":+$", "") != "other"))
    return usable.groupBy(key).agg(F.min_by(said, F.struct(F.char_length(code), F.col(code), F.col(id_col))).alias("heading_text"))


@dataclass(frozen=True)
class Corpus:
    """tariff: rows as in schemas.TARIFF_LINES.  source_date: ISO date or free text."""

    tariff: DataFrame
    source_date: str = ""

    @cached_property
    def leaves(self) -> DataFrame:
        return materialise(leaves(self.tariff), "leaves")

    @cached_property
    def leaf_count(self) -> int:
        return self.leaves.count()

    @cached_property
    def postings(self) -> DataFrame:
        return index.postings(self.leaves, "hs_code", F.col("tokens"))

    @cached_property
    def weights(self) -> DataFrame:
        return materialise(index.with_idf(index.doc_frequency(self.postings), self.leaf_count), "weights")

    @cached_property
    def terms(self) -> DataFrame:
        """Porter stems of every word of the search text, as a full-text index holds them."""
        words = F.regexp_extract_all(F.lower("search_text"), F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0))
        return materialise(index.term_table(self.leaves, "hs_code", porter_udf(words)), "terms")

    @cached_property
    def mean_terms(self) -> float:
        return float(self.terms.select("hs_code", "length").distinct().agg(F.avg("length")).first()[0] or 1.0)

    @cached_property
    def headings(self) -> DataFrame:
        return materialise(heading_text(self.tariff), "headings")

    @cached_property
    def wording(self) -> DataFrame:
        """(heading, digits, wording): of rows that share digits the last by id."""
        said = squash(F.col("description"))
        return materialise(self.tariff.filter(F.col("description") != "").groupBy("heading", "digits").agg(F.max_by(said, "id").alias("wording")), "wording")

    @cached_property
    def date(self) -> str:
        return self.tariff.sparkSession.range(1).select(schedule_date(F.lit(self.source_date))).first()[0]

    def labels(self) -> DataFrame:
        """(hs_code, header): the heading and its wording for each leaf."""
        joined = self.leaves.select("hs_code", "heading").join(self.headings, "heading", "left")
        return joined.select("hs_code", F.trim(F.concat_ws(" ", format_heading(F.col("heading")), "heading_text")).alias("header"))
