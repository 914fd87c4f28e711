"""Listings with titles, and the brief: what is new, what is surprising, and one note or reflection to see again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import char_snippet, strip
from .corpus import replace_by_key

#: Kinds of edges, of which one has a direction; edges listed by default; edges of a brief; length of its snippet.
EDGE_KINDS, DIRECTED, MOST_SPARKS, BRIEF_SPARKS, SNIPPET = ("need_solution", "cross_domain"), "need_solution", 50, 5, 280


def kind_filter(kind: str | None) -> str | None:
    """None for no filter (None, empty, ``all``); a ValueError for a kind that there isn't."""
    if kind in (None, "", "all"):
        return None
    if kind not in EDGE_KINDS:
        raise ValueError(f"no kind {kind}: need_solution, cross_domain or all")
    return kind


def list_sparks(edges: DataFrame, chunks: DataFrame, documents: DataFrame, limit: int = 0, kind: str | None = None) -> DataFrame:
    """The most surprising edges: ``kind``, ``directed``, ``surprise``, ``similarity`` and for both ends a document, its title, the section,
    the chunk's id and snippet.

    ``edges``: ``src_chunk``, ``dst_chunk``, ``kind``, ``similarity``, ``surprise``. ``chunks``: ``vector_id``, ``doc_id``, ``section_type``,
    ``snippet``. An edge one of whose chunks is gone isn't listed and takes no place; a document without a title, or without
    metadata, is called by its id. ``limit`` of 0 is ``MOST_SPARKS``.
    """
    kind = kind_filter(kind)
    edges = (edges if kind is None else edges.filter(F.col("kind") == kind)).select("src_chunk", "dst_chunk", "kind", "similarity", "surprise")
    title = documents.select(F.col("doc_id").alias("owner"), F.nullif("title", F.lit("")).alias("title")).dropDuplicates(["owner"])

    def end(side: str) -> DataFrame:
        named = [F.col("vector_id").alias(f"{side}_chunk"), F.col("doc_id").alias(f"{side}_doc"), F.col("section_type").alias(f"{side}_section")]
        return chunks.select(*named, F.col("snippet").alias(f"{side}_snippet"))

    # Narrow rows first: the edges that count are few once both ends are known to be there.
    there = chunks.select("vector_id")
    for side in ("src", "dst"):
        edges = edges.join(there.withColumnRenamed("vector_id", f"{side}_chunk"), f"{side}_chunk", "left_semi")
    top = edges.orderBy(F.desc("surprise"), "src_chunk", "dst_chunk", "kind").limit(limit or MOST_SPARKS)
    out = top.join(end("src"), "src_chunk").join(end("dst"), "dst_chunk")
    for side in ("src", "dst"):
        own = title.select(F.col("owner").alias(f"{side}_doc"), F.col("title").alias(f"{side}_title"))
        out = out.join(own, f"{side}_doc", "left").withColumn(f"{side}_title", F.coalesce(f"{side}_title", F.col(f"{side}_doc").cast("string")))
    ends = [f"{side}_{what}" for side in ("src", "dst") for what in ("doc", "title", "section", "chunk", "snippet")]
    return out.select("kind", (F.col("kind") == DIRECTED).alias("directed"), "surprise", "similarity", *ends)


def list_candidates(candidates: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Candidates (of one status) by falling score, then the newest, then by id."""
    rows = candidates if status is None else candidates.filter(F.col("status") == status)
    rows = rows.orderBy(F.desc("score"), F.desc_nulls_last("published_at"), "cand_id")
    return rows if limit is None else rows.limit(limit)


def status_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def resurfaced(documents: DataFrame, cursor: DataFrame) -> DataFrame:
    """The note or reflection that was shown longest ago, first those never shown, ties to the smaller id: ``doc_id``, ``kind``,
    ``title``, ``snippet`` of its ``body``. No row if there are none. ``cursor``: ``doc_id``, ``shown_at``."""
    own = documents.filter(F.col("kind").isin("note", "reflection"))
    first = own.join(cursor.select("doc_id", "shown_at"), "doc_id", "left").orderBy(F.asc_nulls_first("shown_at"), "doc_id").limit(1)
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("doc_id").cast("string"))
    return first.select("doc_id", "kind", title.alias("title"), char_snippet(strip(F.coalesce("body", F.lit(""))), SNIPPET).alias("snippet"))


def stamped(cursor: DataFrame, shown: DataFrame, at: Column) -> DataFrame:
    """The cursor once ``shown`` has been shown. Write it elsewhere before it takes the old one's place."""
    return replace_by_key(cursor.select("doc_id", "shown_at"), shown.select("doc_id", at.alias("shown_at")), ["doc_id"])


def brief(
    candidates: DataFrame, sparks: DataFrame, documents: DataFrame, watches: DataFrame, cursor: DataFrame, at: Column, limit: int = 12
) -> tuple[DataFrame, DataFrame]:
    """One row, and the cursor after it: ``generated_at``, ``new_documents`` (the best ``limit`` new candidates), ``sparks`` (of
    :func:`list_sparks`, the first ``BRIEF_SPARKS``), ``resurfaced`` (null without any) and ``stats``. ``limit`` is kept within 1 and 50."""
    limit = min(50, max(1, limit))
    place = "__place"
    newest = (F.desc("score"), F.desc_nulls_last("published_at"), "cand_id")
    surprising = (F.desc("surprise"), "src_chunk", "dst_chunk", "kind")

    def listed(rows: DataFrame, order: tuple, name: str) -> DataFrame:
        """One row of a listing that has been cut to a few rows."""
        numbered = rows.select(F.row_number().over(Window.orderBy(*order)).alias("n"), F.struct(*rows.columns).alias("row"))
        return numbered.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda x: x["row"]).alias(name))

    new = listed(list_candidates(candidates, "new", limit), newest, "new_documents")
    edges = listed(sparks.orderBy(*surprising).limit(BRIEF_SPARKS), surprising, "sparks")
    shown = resurfaced(documents, cursor)
    again = shown.agg(F.first(F.struct(*shown.columns)).alias("resurfaced"))
    counts = documents.agg(F.count(F.lit(1)).alias("documents"))
    news = candidates.filter("status = 'new'").agg(F.count(F.lit(1)).alias("new_candidates"))
    watched = watches.agg(F.count(F.lit(1)).alias("watches"))
    out = None
    for one in (new, edges, again, counts, news, watched):  # a row each
        one = one.withColumn(place, F.lit(0))
        out = one if out is None else out.join(one, place)
    stats = F.struct("documents", "new_candidates", "watches").alias("stats")
    return out.select(at.alias("generated_at"), "new_documents", "sparks", "resurfaced", stats), stamped(cursor, shown, at)
