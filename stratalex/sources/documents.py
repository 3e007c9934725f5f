"""Documents from files, texts and folders.

Files are read by Spark's binaryFile source; what decodes them is given by the caller, since decoders of PDFs and images
are choices of a deployment.  Unsupported files become rows with a warning, not errors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.functions import images
from stratalex.functions.text import enough_text
from stratalex.operators.bitmaps import bitmap, may_hold
from stratalex.operators.lines import documents_with_lines, split_any_lines
from stratalex.operators.windows import number_all
from stratalex.schemas import DOCUMENTS
from stratalex.storage import BATCH_BYTES, bound_batches, materialise

# File types.
IMAGES = "jpg jpeg png webp tif tiff bmp heic heif".split()
SUPPORTED = ["pdf", *IMAGES]
#: Frames that are handed on together, unless they have BATCH_BYTES before.
BATCH_ROWS = 10_000
#: Letters below which a page is read again.
RETRY_LETTERS = 20
NO_RENDERING = "The PDF had no text layer and no pages could be rendered."
NO_PDF_LINES = "No product lines were found after OCR of the PDF pages."
NO_IMAGE_LINES = "No product lines were found in the image."

#: path and bytes -> text, tables, warning (null without one).
Decoder = Callable[[str, bytes], tuple[str, list, str | None]]
#: path and bytes -> text of each frame or page.
Recognizer = Callable[[str, bytes], list[str]]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def route(path: Column, content: Column) -> Column:
    """pdf, image or unsupported, by suffix or by the first bytes."""
    is_pdf = (suffix(path) == "pdf") | (F.substring(content, 1, 5) == F.lit(b"%PDF-"))
    return F.when(is_pdf, "pdf").when(suffix(path).isin("", *IMAGES), "image").otherwise("unsupported")


def list_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, ...) of the supported files below a folder, or of a single file, whatever its type.  A missing
    path raises FileNotFoundError."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        raise FileNotFoundError(path)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df if store.getFileStatus(place).isFile() else df.filter(suffix(F.col("path")).isin(SUPPORTED))


def sorted_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the same files in the order of their paths; contents are not read."""
    return list_inputs(spark, path).select("path", "length").orderBy("path")


def _decoded(files: DataFrame, decode: Decoder) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    got.append(decode(path, bytes(content)))
                except Exception as e:  # a broken file is a warning, not the end of the job
                    got.append(("", [], f"Decoding failed: {e}"))
            yield pd.DataFrame({"path": b["path"], "route": b["route"], "text": [g[0] for g in got], "tables": [g[1] for g in got], "warning": [g[2] for g in got]})

    bound_batches(files.sparkSession)
    return files.select("path", "route", "content").mapInPandas(run, "path string, route string, text string, tables array<array<array<string>>>, warning string")


def expand_frames(files: DataFrame, frames: Callable[[str, bytes], list[bytes]]) -> DataFrame:
    """files(path, content) -> (path, page, frame): a row for each frame of an image or rendered page of a PDF, as the
    given renderer yields them; pages count from 1.  A file that it cannot render has no rows."""

    def table(rows: list[tuple[str, int, bytes]]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["path", "page", "frame"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Frames of many small files go on together, since each table that is handed on costs as much as some hundred rows.
        rows, held = [], 0
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    got = list(frames(path, bytes(content)))
                except Exception:
                    got = []
                for page, frame in enumerate(got, 1):
                    rows.append((path, page, frame))
                    held += len(frame)
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield table(rows)
                        rows, held = [], 0
        if rows:
            yield table(rows)

    bound_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, page int, frame binary")


def recognise_pages(pages: DataFrame, read: Callable[[bytes, str], str], least: int = RETRY_LETTERS) -> DataFrame:
    """pages(path, page, frame) -> (path, page, text, tries).

    A page is read as it is; if that gives fewer than `least` letters, it is read once more after preparation, and the
    reading with more letters counts (the first, if they are equal).  read(frame, way): way is "plain" or "prepared"; a
    reader that fails has read nothing.
    """

    def letters(text: str) -> int:
        return sum(c.isascii() and c.isalpha() for c in text)

    def attempt(frame: bytes, way: str) -> str:
        try:
            return read(frame, way) or ""
        except Exception:
            return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, tries = [], []
            for frame in b["frame"]:
                text, n = attempt(bytes(frame), "plain"), 1
                if letters(text) < least:
                    again, n = attempt(bytes(frame), "prepared"), 2
                    text = again if letters(again) > letters(text) else text
                texts.append(text)
                tries.append(n)
            yield pd.DataFrame({"path": b["path"], "page": b["page"], "text": texts, "tries": tries})

    bound_batches(pages.sparkSession)
    return pages.select("path", "page", "frame").mapInPandas(run, "path string, page int, text string, tries int")


def read_scans(files: DataFrame, frames: Callable[[str, bytes], list[bytes]], pixels: Callable[[bytes], np.ndarray], recognise: Callable[[np.ndarray], str], least: int = RETRY_LETTERS) -> DataFrame:
    """files(path, content) -> (path, page, text, tries): frames rendered, pages set upright, scaled, straightened and evened out
    for the recogniser; where it finds little, it sees the page once more in black and white.

    pixels decodes a frame to an array (height x width, or x 3); recognise reads one.
    """

    def read(frame: bytes, way: str) -> str:
        ready = images.prepare(pixels(frame))
        return recognise(images.hard_threshold(ready) if way == "prepared" else ready)

    return recognise_pages(expand_frames(files, frames), read, least)


def decode_documents(files: DataFrame, decode: Decoder, recognize: Recognizer | None = None) -> DataFrame:
    """schemas.DOCUMENTS of files (path, content).

    A PDF is digital if its text layer has letters enough and at least one product line; others, and images, go to the
    recognizer, which sees only these files.  What yields no product line even then is told by a warning.
    """
    routed = files.select("path", "content", route(F.col("path"), F.col("content")).alias("route"))
    name = F.element_at(F.split("path", "/"), -1).alias("source_file")
    digital = materialise(_decoded(routed.filter("route = 'pdf'"), decode).withColumn("enough", enough_text(F.col("text"))), "digital")
    lined = _with_lines(digital.filter("enough"))
    warned = lambda *w: F.array_compact(F.array(*w))
    good = digital.join(lined, "path", "left_semi").select(name, F.lit("digital_pdf").alias("route"), "text", "tables", warned(F.col("warning")).alias("warnings"))
    poor = digital.join(lined, "path", "left_anti").select("path", F.lit("scanned_pdf").alias("route"), "warning")
    scans = poor.unionByName(routed.filter("route = 'image'").select("path", "route", F.lit(None).cast("string").alias("warning")))
    none = F.array().cast("array<array<array<string>>>")
    no_lines = F.when(F.col("route") == "scanned_pdf", NO_PDF_LINES).otherwise(NO_IMAGE_LINES)
    if recognize is None:
        rest = scans.select(name, "route", F.lit("").alias("text"), none.alias("tables"), warned(F.col("warning"), F.when(F.col("route") == "scanned_pdf", NO_RENDERING).otherwise(NO_IMAGE_LINES)).alias("warnings"))
    else:
        def recognised(path: str, content: bytes) -> tuple[str, list, str | None]:
            pages = recognize(path, content)
            return "\n".join(x for x in pages if x), [], None if pages else NO_RENDERING

        # The files are read again where they lie: a bitmap of paths tells which, and contents do not move.
        scans = materialise(scans, "scans")
        h = F.xxhash64("path")
        again = may_hold(routed.filter("route <> 'unsupported'"), bitmap(scans, h), h)
        seen = _decoded(again, recognised).drop("route").join(scans.select("path", "route"), "path").withColumnRenamed("warning", "late")
        seen = materialise(seen, "recognised")
        found = _with_lines(seen).withColumn("has_lines", F.lit(True))
        rest = seen.join(scans.select("path", "warning"), "path").join(found, "path", "left")
        unseen = (F.col("route") == "scanned_pdf") & F.coalesce(F.col("late") == NO_RENDERING, F.lit(False))
        told = F.when(unseen, F.array(F.lit(NO_RENDERING))).otherwise(warned(F.col("warning"), F.when(F.col("late") != NO_RENDERING, F.col("late")), F.when(F.col("has_lines").isNull(), no_lines)))
        rest = rest.select(name, "route", "text", "tables", told.alias("warnings"))
    bad = routed.filter("route = 'unsupported'").select(name, "route", F.lit("").alias("text"), none.alias("tables"), F.array(F.concat(F.lit("Unsupported file type '"), F.coalesce(F.nullif(suffix(F.col("path")), F.lit("")), F.lit("?")), F.lit("'."))).alias("warnings"))
    return good.unionByName(rest).unionByName(bad)


def _with_lines(decoded: DataFrame) -> DataFrame:
    """(path) of the documents that have a product line."""
    return materialise(documents_with_lines(decoded.select("path", "text", "tables"), "path"), "with-lines")


def pasted_text(spark: SparkSession, text: str, source: str = "pasted descriptions") -> DataFrame:
    return spark.createDataFrame([(source, "text", text, [], [])], DOCUMENTS)


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of schedule texts, one row per file."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.col("value").alias("text"))


def read_schedule_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, pos, line) of schedule texts, for schedules too long for one row: files are split as Spark reads them,
    and lines numbered over the splits in their order."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    df = spark.read.text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"), at.alias("at"), F.col("value").alias("line"))
    df = number_all(df, "source_file", "at", "n")
    parts = df.select("source_file", "n", F.posexplode(split_any_lines(F.col("line"))).alias("k", "line"))
    return parts.select("source_file", (F.col("n") * (1 << 20) + F.col("k")).alias("pos"), "line")
