"""Feed files as a stream: entries are scored against the corpus and brought into the table of candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import upsert_candidates
from ..plans.lineage import cut
from ..sources.files import read_atom

CANDIDATE_COLUMNS = ("cand_id", "title", "abstract", "authors", "categories", "published_at", "score", "why")


def refreshed_candidates(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """The table of candidates after scored entries (``doc_id`` and the rest of :data:`CANDIDATE_COLUMNS`) have come in: absent ones come as
    new, those that are still new are refreshed, others stay as their user left them."""
    new = scored.withColumnRenamed("doc_id", "cand_id").select(*CANDIDATE_COLUMNS)
    return upsert_candidates(candidates, new).drop("inserted")


def watch_feeds(
    spark: SparkSession,
    folder: str,
    score: Callable[[DataFrame], DataFrame],
    accept: Callable[[DataFrame], None],
    failures: str,
    checkpoint: str,
    files_a_batch: int = 1000,
):
    """Start a query over the feed files (``.xml``) of a folder: ``score`` takes a batch's entries, ``accept`` what it returns; both must be
    idempotent, as a batch may come again. Files without an entry are told in ``failures`` and don't hold the others up.

    Feeds that overlap give an entry once. The driver handles names of files only, ``files_a_batch`` at most.
    """
    rows = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).text(f"{folder}/*.xml")

    def run(batch: DataFrame, number: int) -> None:
        names = [r[0] for r in batch.select(F.col("file")).distinct().collect()]  # files_a_batch at most
        if not names:
            return
        entries = cut(read_atom(spark, names).withColumn("file", F.input_file_name()))
        accept(score(entries.drop("file").dropDuplicates(["doc_id"])))
        read = entries.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("name")).distinct()
        empty = batch.select("file", F.regexp_extract("file", r"([^/]+)$", 1).alias("name")).distinct().join(read, "name", "left_anti")
        empty.select("file", F.lit("no entry").alias("reason")).write.mode("overwrite").parquet(f"{failures}/batch={number}")

    return (
        rows.select(F.col("_metadata.file_path").alias("file"))
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
