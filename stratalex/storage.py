"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Bytes that an Arrow batch may hold, unless one row has more: bounds a Python worker's memory whatever the length of
#: texts and files.
BATCH_BYTES = 4_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's setting by which the shuffle files of a query go with its end, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, for operators that hand whole texts to Python.  Plans read the setting when they
    run, after the operator has returned, so it stays set; a limit that the caller has chosen is left as it is."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where it is unset, a temporary folder on a local master, which goes with the
    process; on a cluster an error, since executors would each write to their own disk and rows would be missing."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is unset on {master}: it must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="stratalex-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = "file://" + made
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a query that ends within goes with its end."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut and a lost executor costs nothing.  Nothing
    reads what was shuffled for it again, so that goes at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalex/{name}-{uuid.uuid4().hex}"
    with cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratalex_path = path  # for discard()
    return out


def is_stored(df: DataFrame) -> bool:
    """Whether df is a table that materialise() wrote, which need not be written again to be read twice."""
    return getattr(df, "_stratalex_path", None) is not None


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and no later step reads."""
    for df in tables:
        path = getattr(df, "_stratalex_path", None)
        if path:
            spark = df.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
