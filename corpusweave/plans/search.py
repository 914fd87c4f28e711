"""Hybrid search over a corpus: dense, lexical and graph lists, fused and grouped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph_rank, lexical, ranking
from ..operators.vectors import knn_join
from .lineage import cut

#: Fixed value: how many times the wanted hits are taken from each list before they are fused.
POOL = 4


def dense_pool(queries: DataFrame, chunks: DataFrame, pool: int, floor: float, as_of, allowed: DataFrame | None = None, **knn) -> DataFrame:
    """The ``pool`` nearest chunks per query at or above the floor, ranked by blended score. ``allowed`` (``vector_id``): those that
    can be found. ``knn``: further arguments of :func:`..operators.vectors.knn_join`."""
    near = knn_join(queries, chunks, pool, "query_id", "vector_id", allow=allowed, **knn).filter(F.col("cos") >= floor).drop("rank")
    rows = near.join(chunks.select("vector_id", "section_type", "embedded_at"), "vector_id")
    score = ranking.blended(F.col("cos"), ranking.recency(F.col("embedded_at"), as_of), ranking.importance(F.col("section_type")))
    return ranking.ranked(rows.withColumn("score", score), "query_id", "score", "vector_id")


def dense_list(queries: DataFrame, chunks: DataFrame, k: int, pool: int, floor: float, as_of) -> DataFrame:
    """``k`` chunks per query by blended score, from a pool of ``pool`` nearest ones at or above the floor."""
    return dense_pool(queries, chunks, pool, floor, as_of).filter(F.col("rank") <= k)


def lexical_list(queries: DataFrame, chunks: DataFrame, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """``limit`` chunks per query by BM25; only then those outside of ``allowed`` (``vector_id``) fall away."""
    out = lexical.top_matches(queries, chunks, limit, words=True, zeros=True)
    return out if allowed is None else out.join(allowed.select("vector_id"), "vector_id", "left_semi")


def phrase_list(
    queries: DataFrame, chunks: DataFrame, limit: int, allowed: DataFrame | None = None, stemmer: Callable[[str], str] | None = None
) -> DataFrame:
    """As :func:`lexical_list`, where a token with marks inside must be found as a phrase, and terms may be stemmed. Where ``allowed``
    has gaps the ranks keep theirs from before: the list is cut first."""
    out = lexical.top_matches(queries, chunks, limit, stemmer, zeros=True)
    if allowed is None:
        return out
    kept = out.join(allowed.select("vector_id"), "vector_id", "left_semi").drop("rank")
    return ranking.ranked(kept, "query_id", "score", "vector_id")


def fused_lists(
    queries: DataFrame,
    chunks: DataFrame,
    links: DataFrame | None,
    k: int,
    floor: float,
    as_of,
    allowed: DataFrame | None = None,
    stemmer: Callable[[str], str] | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    neighbors: int = graph_rank.NEIGHBORS,
) -> DataFrame:
    """The best ``k`` chunks per query of three lists: ``query_id``, ``vector_id``, ``score``, ``rank``.

    ``queries``: ``query_id``, ``query``, ``embedding``. ``chunks``: ``vector_id``, ``doc_id``, ``section_type``, ``embedded_at``,
    ``text``, ``embedding``; every list has chunks of this table only, so no hit is lost once they are fused. The dense list is
    the whole pool of ``POOL`` times ``k``; the graph list (``links`` as :func:`..operators.graph_rank.ppr_rank` has them; None
    for no such list) spreads from it. ``allowed``: the chunks (``vector_id``) that can be found.
    """
    dense = cut(dense_pool(queries, chunks, POOL * k, floor, as_of, allowed))
    lists = [(dense, weights[0]), (phrase_list(queries, chunks, POOL * k, allowed, stemmer), weights[1])]
    if links is not None:
        lists.append((graph_rank.ppr_rank(dense.select("query_id", "vector_id", "cos"), chunks, links, neighbors, allow=allowed), weights[2]))
    return ranking.fuse(lists, k)


def grouped(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fused hits by document."""
    return ranking.group_hits(hits.join(chunks.select("vector_id", "doc_id", "section_type"), "vector_id"))
