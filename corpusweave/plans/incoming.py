"""Incoming documents, scored by what they connect to in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus, ranking
from ..operators.vectors import knn_join
from .embedding import Embedder, embed_texts
from .lineage import cut
from .modes import pool

#: Documents that count as connections, and those named as reasons.
CONNECTIONS, REASONS, SYNTHESIS = 8, 4, 5


def score_incoming(entries: DataFrame, chunks: DataFrame, documents: DataFrame, embedder: Embedder, dim: int, **knn) -> DataFrame:
    """Entries that the corpus doesn't have, with ``score`` and ``why``.

    ``entries``: ``doc_id``, ``title``, ``abstract``, further columns. ``chunks``: ``vector_id``, ``doc_id``, ``section_type``, ``embedding``.
    ``documents``: ``doc_id``, ``title``, ``kind``. ``why`` holds the best ``REASONS`` documents that the entry connects to (``doc_id``,
    ``title``, ``kind``, ``score``, ``sections``), and whether a note or a reflection is among the first ``SYNTHESIS``. An entry that
    connects to nothing scores 0. Of entries with one id, one counts; equal texts are embedded once.
    """
    fresh = corpus.orphans(entries.filter("doc_id is not null").dropDuplicates(["doc_id"]), documents, "doc_id")
    text = F.trim(F.concat_ws("\n\n", "title", "abstract"))
    fresh = cut(fresh.withColumn("__text", text).withColumn("__hash", F.sha2("__text", 256)))
    asked = fresh.select(F.col("__hash").alias("content_hash"), F.col("__text").alias("text")).dropDuplicates(["content_hash"])
    vectors = cut(embed_texts(asked, embedder, dim).withColumnRenamed("content_hash", "query_id"))
    hits = knn_join(vectors, chunks, pool("connections", CONNECTIONS), "query_id", "vector_id", **knn)
    hits = hits.select("query_id", "vector_id", "cos", "rank").join(chunks.select("vector_id", "doc_id", "section_type"), "vector_id")
    about = documents.select("doc_id", F.col("title").alias("connected_title"), F.coalesce("kind", F.lit("paper")).alias("kind"))
    linked = cut(ranking.connection_strength(hits, CONNECTIONS).join(about, "doc_id", "left"))
    score = ranking.relevance(linked)
    named = F.struct("place", "doc_id", F.coalesce("connected_title", F.col("doc_id").cast("string")).alias("title"), "kind", "score", "sections")
    why = linked.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= REASONS, named))), lambda x: x.dropFields("place")).alias("connections"),
        F.max((F.col("place") <= SYNTHESIS) & F.col("kind").isin("note", "reflection")).alias("connects_to_synthesis"),
    )
    told = score.join(why, "query_id").select(F.col("query_id").alias("__hash"), F.col("score").alias("score"), F.struct("connections", "connects_to_synthesis").alias("why"))
    return fresh.join(told, "__hash", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).drop("__hash", "__text")
