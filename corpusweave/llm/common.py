"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

_AREAS: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``), or the innermost :func:`scratch_area` in it.

    Only a session with a local master, as in tests, may lack the setting: it gets a new local folder. On a
    cluster that would be another folder on every machine, so there it is an error.
    """
    if _AREAS:
        return _AREAS[-1]
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java.get() if java.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_area(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for what is staged inside; deleted at the end, so results must be written before."""
    area = f"{scratch_dir(spark)}/area-{uuid.uuid4().hex}"
    _AREAS.append(area)
    try:
        yield area
    finally:
        _AREAS.remove(area)
        delete(spark, area)


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(spark: SparkSession) -> None:
    """Have shuffle files of finished jobs deleted. Spark's cleaner does so when the driver finds their plans unused,
    which it otherwise looks for every half an hour."""
    gc.collect()
    time.sleep(1.5)  # Python tells the JVM which plans it no longer holds once a second
    spark.range(1).count()  # so that the last plan that ran isn't the one to go
    spark._jvm.java.lang.System.gc()


def discard(staged: DataFrame) -> None:
    """Delete a table of :func:`stage`, and release shuffles. All that was made from it must have been written."""
    delete(staged.sparkSession, staged.staged_at)
    release(staged.sparkSession)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character kept.

    ``lower`` does that for texts that are ASCII throughout, and much faster than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for ids kept from training: crc32 of the id's decimal text, modulo ``modulus``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
