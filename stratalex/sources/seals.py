"""A register of seals: a row for each sealed line, bucketed by the seal's token.

A token is drawn from a secret, the report and what it says, so that sealing a report again, as a retry does, gives the token that it
has and appends nothing.  A lookup reads the one bucket that may hold the token, and of it what Parquet's Bloom filter of the
tokens lets through.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "seal string, author string, checked_at timestamp, source string, place long, description string, hs_code string, flag string, amended boolean"


@dataclass(frozen=True)
class Register:
    """Seals in tables under `path`.  Only listed authors may seal."""

    spark: SparkSession
    path: str
    authorisers: tuple[str, ...]
    buckets: int = 16

    @property
    def table(self) -> str:
        """The register's name in this session's catalogue; its files belong to the path."""
        name = f"stratalex_seals_{hashlib.md5(self.path.encode()).hexdigest()[:12]}"
        if not self.spark.catalog.tableExists(name):
            place = self.path.replace("'", "\\'")
            bloom = "OPTIONS ('parquet.bloom.filter.enabled#seal' 'true', 'parquet.bloom.filter.expected.ndv#seal' '100000')"
            self.spark.sql(f"CREATE TABLE {name} ({COLUMNS}) USING parquet {bloom} CLUSTERED BY (seal) SORTED BY (seal, place) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return name

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def tokens(self, lines: DataFrame, report: str, secret: str, author: str) -> DataFrame:
        """(report, seal) of each report: nine bytes, as 12 letters that a URL may hold."""
        said = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("place", "description", "hs_code", "flag", "amended")))
        # The digests of the lines are added up, so that a report of any length is combined where its lines are.
        part = lambda k: F.sum(F.conv(F.substring(F.sha2(said, 256), 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
        whole = lines.groupBy(report).agg(*(part(k).alias(f"d{k}") for k in range(4)), F.count(F.lit(1)).alias("n"))
        digest = F.sha2(F.concat_ws("\x1f", F.lit(secret), F.lit(author), F.col(report).cast("string"), *(F.col(f"d{k}").cast("string") for k in range(4)), F.col("n").cast("string")), 256)
        return whole.select(report, F.translate(F.base64(F.unhex(F.left(digest, F.lit(18)))), "+/", "-_").alias("seal"))

    def seal(self, lines: DataFrame, report: str, author: str, secret: str) -> DataFrame:
        """Seal each report of lines(report, place, description, hs_code, flag, amended) -> (report, seal).

        Reports whose token the register has are left as they are; so repeating a call that broke off appends what is missing.
        """
        if author not in self.authorisers:
            raise ValueError("this author may not seal")
        tokens = self.tokens(lines, report, secret, author)
        new = tokens.join(self.rows().select("seal").distinct(), "seal", "left_anti")
        text = lambda c: F.coalesce(c, F.lit("")).alias(c)
        rows = lines.join(new, report).select("seal", F.lit(author).alias("author"), F.current_timestamp().alias("checked_at"), F.col(report).cast("string").alias("source"), F.col("place").cast("long").alias("place"), text("description"), text("hs_code"), text("flag"), F.coalesce("amended", F.lit(False)).alias("amended"))
        rows.repartition(self.buckets, "seal").write.mode("append").insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        return tokens

    def lookup(self, token: str | Column) -> DataFrame:
        """The lines of a seal; none if it is unknown."""
        return self.rows().filter(F.col("seal") == token)

    def verify(self, tokens: DataFrame) -> DataFrame:
        """tokens(seal) -> (seal, known, n_lines): many at once; the register's rows do not move."""
        counts = self.rows().groupBy("seal").agg(F.count(F.lit(1)).alias("n_lines"))
        return tokens.join(counts, "seal", "left").select("seal", F.col("n_lines").isNotNull().alias("known"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
