"""Line deduplication by overlapping windows of three lines.

Windows are hashed where the text is read.  A window that occurs more than once in the corpus has a first occurrence, by
(id, text hash, line); the lines that later occurrences cover are merged and removed.  Every removed line has an earlier
equal, so no content vanishes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import materialise, tune, type_of, whole

#: Consecutive lines of a window.
WINDOW = 3


def windows(docs: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """(id, th, pos, h1, h2): th the text's hash, pos the window's first line, (h1, h2) its 128-bit hash."""
    text = whole(text_col)
    df = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n", -1).alias("lines")).filter(F.size("lines") >= size)
    df = df.select("id", "th", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - size)).alias("pos"))
    window = F.array_join(F.slice("lines", F.col("pos") + 1, size), "\n")
    return df.select("id", "th", "pos", window.alias("w")).select("id", "th", "pos", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("second"), "w").alias("h2"))


def covered(found: DataFrame) -> DataFrame:
    """(id, th, starts): the first lines of the windows that occurred before."""
    place: Column = F.struct("id", "th", "pos")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "first")
    repeated = materialise(repeated, "repeated")  # read anew, so that the join can split a window that is everywhere
    later = found.join(repeated, ["h1", "h2"]).filter(F.struct("id", "th", "pos") > F.col("first"))
    return later.groupBy("id", "th").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, text, n_lines, n_removed; text without the lines that repeat earlier ones.

    Lines end at newline characters and are compared exactly.  Null counts as empty; texts under `size` lines keep all.
    Rows that repeat id and text count as one document and return equal texts.  Null ids are least.  Texts of any length
    are read whole.  An empty table gives an empty result; other columns are ignored.
    """
    tune(docs.sparkSession)
    cut = covered(windows(docs, id_col, text_col, size)).withColumnsRenamed({"id": "_id", "th": "_th"})
    text = whole(text_col)
    rows = docs.select(F.col(id_col), text.alias("_text"), F.xxhash64(text).alias("_here"))
    rows = rows.join(cut, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_here") == F.col("_th")), "left").select(id_col, "_text", "starts")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_removed = [], [], []
            for text, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines = text.split("\n")
                keep = np.ones(len(lines), bool)
                for s in starts or ():
                    keep[s : s + size] = False
                texts.append("\n".join(x for x, k in zip(lines, keep) if k) if starts else text)
                n_lines.append(len(lines))
                n_removed.append(int((~keep).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=[id_col, "text", "n_lines", "n_removed"])

    return rows.mapInArrow(remove, f"`{id_col}` {type_of(docs, id_col)}, text string, n_lines long, n_removed long")
