"""Filters, recency, blending, fusion and grouping of ranked chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much a section counts by itself.
IMPORTANCE = {
    "reflection": 1.00, "user_notes": 0.90, "future_work": 0.80, "abstract": 0.75, "conclusion": 0.70, "applications": 0.65,
    "introduction": 0.60, "method": 0.60, "limitations": 0.55, "experiments": 0.50, "background": 0.45, "other": 0.35,
}
RRF_K = 60


def filter_chunks(
    chunks: DataFrame,
    sections: list[str] | None = None,
    docs: list | None = None,
    tags: list[str] | None = None,
    kind: str | None = None,
    projects: list[str] | None = None,
) -> DataFrame:
    """All given filters hold; inside each, any value. None is no filter, an empty list matches nothing.

    A chunk without a kind counts as a paper; without a project it matches none.
    """
    out = chunks
    for name, values in (("section_type", sections), ("doc_id", docs), ("project", projects)):
        if values is not None:
            out = out.filter(F.col(name).isin(list(values)) if values else F.lit(False))
    if tags is not None:
        out = out.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags else F.lit(False))
    if kind is not None:
        out = out.filter(F.coalesce("kind", F.lit("paper")) == kind)
    return out


def recency(at: Column, as_of: Column, half_life_days: float = 180.0) -> Column:
    """Halves every half-life; 1 for the future, 0.5 where the time is unknown."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400.0)
    return F.when(at.isNull(), 0.5).otherwise(F.exp(-F.log(F.lit(2.0)) * age / max(half_life_days, 1.0)))


def importance(section: Column) -> Column:
    out = None
    for name, value in IMPORTANCE.items():
        out = F.when(section == name, value) if out is None else out.when(section == name, value)
    return out.otherwise(IMPORTANCE["other"])


def blended(cos: Column, recent: Column, important: Column, weights=(0.85, 0.05, 0.10)) -> Column:
    return F.round(weights[0] * cos + weights[1] * recent + weights[2] * important, 6)


def ranked(df: DataFrame, by: str, score: str, tie: str, k: int | None = None) -> DataFrame:
    """``rank`` from 1 by falling score, ties by rising ``tie``; only the first ``k``."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)))
    return out if k is None else out.filter(F.col("rank") <= k)


def fuse(lists: list[tuple[DataFrame, float]], k: int, query: str = "query_id", item: str = "vector_id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``query``, ``item``, ``rank``) with weights; the best ``k``."""
    parts = None
    for ranks, weight in lists:
        part = ranks.select(query, item, (weight / (RRF_K + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    total = parts.groupBy(query, item).agg(F.round(F.sum("part"), 9).alias("score"))
    return ranked(total, query, "score", item, k)


def group_hits(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Hits (``query``, ``doc_id``, ``vector_id``, ``section_type``, ``score``, ``rank``) by document: best score,
    distinct sections and chunks in rank order, and the document's place."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "vector_id", "section_type")))
    groups = hits.groupBy(query, "doc_id").agg(F.max("score").alias("best_score"), F.min("rank").alias("first"), listed.alias("h"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("best_score"), "first"))
    return groups.select(
        query,
        "doc_id",
        "best_score",
        F.array_distinct(F.transform("h", lambda x: x["section_type"])).alias("sections"),
        F.transform("h", lambda x: x["vector_id"]).alias("chunk_ids"),
        place.cast("long").alias("place"),
    )


def connection_strength(hits: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """Documents that a pool of hits (``query``, ``doc_id``, ``section_type``, ``cos``, ``rank``) connects to.

    Best cosine per document, the first ``k`` documents by first appearance; the pool is read up to the first hit
    of the last of them, and at most three sections are named per document.
    """
    first = F.min("rank").over(Window.partitionBy(query, "doc_id"))
    seen = hits.withColumn("first", first)
    order = F.dense_rank().over(Window.partitionBy(query).orderBy("first"))
    kept = seen.withColumn("place", order).filter(F.col("place") <= k)
    stop = F.max("first").over(Window.partitionBy(query))
    read = kept.withColumn("stop", stop).filter(F.col("rank") <= F.col("stop"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "section_type")))
    return read.groupBy(query, "doc_id").agg(
        F.max("cos").alias("score"),
        F.slice(F.array_distinct(F.transform(listed, lambda x: x["section_type"])), 1, 3).alias("sections"),
        F.min("place").cast("long").alias("place"),
    )


def relevance(connections: DataFrame, query: str = "query_id") -> DataFrame:
    """0.7 of the best score, 0.3 of the mean of three, and 0.05 more if a note or reflection is among five."""
    top = F.coalesce(F.max(F.when(F.col("place") == 1, F.col("score"))), F.lit(0.0))
    three = F.coalesce(F.avg(F.when(F.col("place") <= 3, F.col("score"))), F.lit(0.0))
    own = F.max(F.when((F.col("place") <= 5) & F.col("kind").isin("note", "reflection"), 0.05).otherwise(0.0))
    total = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.7 * top + 0.3 * three + own))
    return connections.groupBy(query).agg(F.round(total, 8).alias("score"))
