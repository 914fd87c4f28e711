"""Change streams: events to documents, debouncing by sessions, and state-driven synchronisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the files of a document folder whose change matters.
WATCHED = ("notes.md", "sections.md", "metadata.json", "idea.md")


def document_events(events: DataFrame, root: str = "") -> DataFrame:
    """``doc_id``, ``op``, ``ts`` of events (``path``, ``op``, ``ts``) on documents, the folders right below ``root``.

    Removals of anything in a folder, and every change of the folder itself, always count, other changes only of watched
    files; hidden folders, the inbox and paths elsewhere are ignored.
    """
    base = F.lit(root.rstrip("/") + "/" if root else "")
    inside = F.regexp_replace(F.expr("substring(path, length(base) + 1)"), "^/+", "")
    rows = events.withColumn("base", base).filter(F.startswith("path", "base")).withColumn("inside", inside)
    doc, name = F.regexp_extract("inside", r"^([^/]+)", 1), F.regexp_extract("inside", r"([^/]+)/*$", 1)
    itself = ~F.col("inside").rlike("^[^/]+/+[^/]")
    rows = rows.select(doc.alias("doc_id"), "op", "ts", name.alias("name"), itself.alias("itself"))
    rows = rows.filter((F.col("doc_id") != "") & ~F.startswith("doc_id", F.lit(".")) & (F.col("doc_id") != "inbox"))
    return rows.filter((F.col("op") == "remove") | F.col("itself") | F.col("name").isin(*WATCHED)).drop("name", "itself")


def debounce(events: DataFrame, quiet: str = "2 seconds", key: str = "doc_id", at: str = "ts") -> DataFrame:
    """One row per burst of events of a document: ``key``, ``started``, ``ended``, ``n_events``, ``op`` (the last).

    In a stream, call ``withWatermark`` on ``events`` first (ten minutes is a good bound): the state of a session is
    kept until it passes, and later rows are dropped.
    """
    return (
        events.groupBy(key, F.session_window(at, quiet).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.max_by("op", at).alias("op"))
        .select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events", "op")
    )


def synchronise(changes: DataFrame, rebuild: Callable[[DataFrame], None], remove: Callable[[DataFrame], None], checkpoint: str):
    """Start a query that hands each batch's documents to ``rebuild`` or ``remove``, by their last operation.

    Both are called with a DataFrame of ``doc_id`` and must be idempotent, as a batch may come again after a failure.
    """

    def run(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max_by("op", "ended").alias("op"))
        gone = F.col("op") == "remove"
        rebuild(last.filter(~gone).select("doc_id"))
        remove(last.filter(gone).select("doc_id"))

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inbox(spark, path: str, done: str):
    """A stream over text files dropped into a folder: ``file``, ``extension``, ``value``; consumed files move to ``done``."""
    rows = spark.readStream.option("wholetext", True).option("cleanSource", "archive").option("sourceArchiveDir", done).text(path)
    file = F.col("_metadata.file_path")
    return rows.select(file.alias("file"), F.lower(F.regexp_extract(file, r"\.([^./]+)$", 1)).alias("extension"), "value")
