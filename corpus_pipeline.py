"""A pipeline that makes training text from the ``documents`` table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes every stage's result as
Parquet to the shared folder and reads it back as the next one's ``docs``. All stages but the last return the
columns of ``documents``.

In every stage null texts count as empty, texts of any length are read whole, further columns of ``docs`` are kept by
all but the last, and an empty table gives an empty result. What each does with ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from corpusweave.llm.common import stage
from corpusweave.llm.queries import table, vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labels of the table.

    A score equal to the threshold keeps a document; repeated rows have one score, so all stay or none.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep_good(docs, model, 0.3)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; of repeated rows with that id, one."""
    return exact_dedup.dedup_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity of 0.8 or more): that with the least
    id. Rows without an id or without words stay; of repeated rows with one id all stay or none."""
    return jaccard_join.keep_one(docs, k=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in passages of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives its text back."""
    coded = bpe.encode_documents(docs, vocabulary_path())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: A trained classifier has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
