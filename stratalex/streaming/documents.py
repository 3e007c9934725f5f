"""Structured Streaming facade: every stateful operator is scoped to one document, so a stream of documents runs the batch
plan batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stratalex.operators.corpus import Corpus
from stratalex.operators.lines import extract_lines
from stratalex.plans.classify import classify_lines


def classify_stream(documents: DataFrame, corpus: Corpus, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """documents: a streaming DataFrame of schemas.DOCUMENTS; results are appended to Parquet in `out`.

    A repeated batch overwrites its own folder, so retries do not repeat rows.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        classify_lines(extract_lines(batch), corpus).write.mode("overwrite").parquet(f"{out}/batch={n}")
        batch.unpersist()

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
