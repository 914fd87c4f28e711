"""Modes and pools: how many hits a query gets, from how many candidates, above which floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from ..operators.vectors import knn_join
from .binding import SECTIONS

# Hits and least cosine of each mode; bounds and defaults of what callers may ask for.
MODES = {"narrow": (10, 0.30), "wide": (40, 0.0)}
LIMITS = {
    "search": (1, 100, 10), "problems": (1, 30, 8), "similar": (1, 50, 8), "graph": (0, 10, 3), "sparks": (1, 500, 50), "brief": (1, 50, 12),
}


def clamped(what: str, k: int | None) -> int:
    """What a caller gets that asks for ``k`` of something; its default for none."""
    least, most, usual = LIMITS[what]
    return usual if k is None else min(most, max(least, k))


def pool(what: str, k: int) -> int:
    """Candidates that are looked at for ``k`` hits; documents found depend on it."""
    clamp = lambda n, low, high: max(low, min(high, n))
    return {
        "search": lambda: 4 * k,
        "connections": lambda: max(4 * k, k),
        "similar": lambda: clamp(12 * (k + 1), 20, 300),
        "graph": lambda: clamp(12 * (k + 1), 20, 200),
        "edges": lambda: clamp(4 * (k + 1), k + 1, 200),
        "solutions": lambda: clamp(8 * (k + 1), 20, 200),
    }[what]()


def given(values: list | None) -> list | None:
    """A filter as a caller means it: an empty list is none."""
    return values or None


def known_sections(sections: list[str] | None) -> list[str] | None:
    """Section types of the closed list; others are a ValueError."""
    unknown = sorted(set(sections or ()) - set(SECTIONS))
    if unknown:
        raise ValueError(f"no section type: {', '.join(unknown)}; there are {', '.join(SECTIONS)}")
    return sections


def with_modes(queries: DataFrame) -> DataFrame:
    """Queries with ``k``, ``floor`` and ``pool``. ``mode`` gives the defaults (null is narrow, another mode an error), a ``k`` of the
    row's own is kept within the limits, and so is the pool."""
    mode = F.coalesce("mode", F.lit("narrow"))

    def of(value: int) -> Column:
        out = F.when(mode == "narrow", F.lit(MODES["narrow"][value]))
        return out.when(mode == "wide", F.lit(MODES["wide"][value])).otherwise(F.raise_error(F.concat(F.lit("no mode "), mode)).cast("double"))

    least, most, _ = LIMITS["search"]
    own = (F.col("k") if "k" in queries.columns else F.lit(None)).cast("int")
    k = F.when(own.isNull(), of(0).cast("int")).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), own)))
    return queries.withColumn("k", k).withColumn("floor", of(1)).withColumn("pool", F.col("k") * 4)


def mode_search(queries: DataFrame, chunks: DataFrame, as_of, **knn) -> DataFrame:
    """Dense search where each query has its own mode: ``query_id``, ``vector_id``, ``cos``, ``score``, ``rank``.

    ``queries``: ``query_id``, ``embedding``, ``mode`` and maybe ``k``. The join takes the largest pool that a query may have, and each
    query's list is cut at its own pool before its floor counts, then at its own ``k`` by blended score.
    """
    asked = with_modes(queries)
    widest = asked.agg(F.max("pool")).first()[0] or 1
    near = knn_join(asked, chunks, widest, "query_id", "vector_id", **knn).join(asked.select("query_id", "k", "floor", "pool"), "query_id")
    near = near.filter("rank <= pool and cos >= floor").drop("rank").join(chunks.select("vector_id", "section_type", "embedded_at"), "vector_id")
    score = ranking.blended(F.col("cos"), ranking.recency(F.col("embedded_at"), as_of), ranking.importance(F.col("section_type")))
    out = ranking.ranked(near.withColumn("score", score), "query_id", "score", "vector_id")
    return out.filter("rank <= k").select("query_id", "vector_id", "cos", "score", "rank")
