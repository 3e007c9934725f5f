"""Operators whose state outlives a micro-batch: the first row of a key over all files, and numbers that go on.

State is kept per key (RocksDB, in the query's checkpoint), so keys spread over the cluster and a restarted query goes on where
it stopped.  Within a micro-batch rows count in the order of given columns, before all rows of later batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FILES = "path string, modificationTime timestamp, length long, content binary"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind needs the RocksDB store; it is set for the session, where queries read it when they start."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def text_lines(spark: SparkSession, path: str, files_at_a_time: int | None = None) -> DataFrame:
    """(path, pos, line) of text files (UTF-8) as they come into a folder or those below it: a stream."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if files_at_a_time:
        reader = reader.option("maxFilesPerTrigger", files_at_a_time)
    text = F.decode("content", "UTF-8")
    lines = F.split(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")
    return reader.load(path).select("path", F.posexplode(lines).alias("pos", "line"))


class _First(StatefulProcessor):
    """The first row of a key, once."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        best = None
        for some in rows:
            some = some if best is None else pd.concat([best, some])
            best = some.sort_values(self.order, kind="stable").head(1)
        self.seen.update((True,))
        yield best

    def close(self) -> None:
        pass


class _Numbered(StatefulProcessor):
    """Rows of a key, numbered on from the last number that was given."""

    def __init__(self, order: list[str], name: str):
        self.order, self.name = order, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else 0
        some = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        some[self.name] = range(last + 1, last + 1 + len(some))
        self.last.update((last + len(some),))
        yield some

    def close(self) -> None:
        pass


def first_wins(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key that the stream ever brings.  No key is empty for null: give a column that tells."""
    use_rocksdb(stream.sparkSession)
    return stream.groupBy(*keys).transformWithStateInPandas(_First(order), stream.schema, "Append", "None")


def number_on(stream: DataFrame, keys: list[str], order: list[str], name: str = "line_number") -> DataFrame:
    """The stream's rows with numbers 1, 2, ... within each key, over all micro-batches.  What one micro-batch has of a key is
    held at once: files_at_a_time bounds it."""
    use_rocksdb(stream.sparkSession)
    schema = T.StructType([*stream.schema.fields, T.StructField(name, T.LongType())])
    return stream.groupBy(*keys).transformWithStateInPandas(_Numbered(order, name), schema, "Append", "None")


def append(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Take what is there, in micro-batches, append it to Parquet in `out`, each batch once, and stop."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
