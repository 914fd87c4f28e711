"""The user's side of a corpus: look-ups, notes, bookmarks, watches, outlines and neighbours in the graph.

Tables that users change (watches, bookmarks, notes, tags) are taken and returned whole; write the result elsewhere before it
takes the old one's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import slug, strip

#: Characters of a note's preview, the project of notes without one, and what a link weighs more than any cosine.
PREVIEW, NO_PROJECT, LINK_LEAD = 200, "global", 100.0


def chunks_by_id(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks with the ``chunk_id`` of ``wanted``; unknown ids give none, repeated ones one each."""
    return chunks.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi")


def chunks_of_documents(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of the documents (``doc_id``) of ``wanted``, by document and id."""
    return chunks.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").orderBy("doc_id", "vector_id")


def hydrated(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked ids (``vector_id``, ``rank``, maybe ``query_id``) with their chunks, in the order of the ranks; ids without a chunk are
    left out, and the ranks of the others stay."""
    order = [c for c in ("query_id", "rank") if c in ranked.columns]
    return ranked.join(chunks, "vector_id").orderBy(*order)


def documents_of_kind(documents: DataFrame, kind: str) -> DataFrame:
    """Ids of the documents of a kind, in order; those without one are papers."""
    return documents.filter(F.coalesce("kind", F.lit("paper")) == kind).select("doc_id").orderBy("doc_id")


def list_notes(documents: DataFrame) -> DataFrame:
    """Notes (``doc_id``, ``title``, ``project``, ``updated_at``, ``body``), newest first, each with the first characters of its text."""
    preview = F.substring(strip(F.coalesce("body", F.lit(""))), 1, PREVIEW).alias("preview")
    notes = documents.filter("kind = 'note'").select("doc_id", "title", F.coalesce("project", F.lit(NO_PROJECT)).alias("project"), "updated_at", preview)
    return notes.orderBy(F.desc_nulls_last("updated_at"), "doc_id")


def list_bookmarks(bookmarks: DataFrame, documents: DataFrame) -> DataFrame:
    """Bookmarked documents, the latest first; bookmarks of documents that are gone aren't listed. ``bookmarks``: ``doc_id``,
    ``created_at``."""
    return bookmarks.join(documents, "doc_id").orderBy(F.desc("created_at"), "doc_id")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with those rows of ``new`` whose keys it doesn't have, as when a bookmark or a watch is set again; of several new rows
    with one key the first by the order of their columns counts."""
    first = Window.partitionBy(*keys).orderBy(*(c for c in old.columns if c not in keys))
    fresh = new.join(old.select(*keys), keys, "left_anti").select(*old.columns)
    return old.unionByName(fresh.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n"))


def set_column(rows: DataFrame, chosen: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """``rows`` with ``column`` set where ``chosen`` has their key: a candidate's status, whether a watch is enabled, when it was
    refreshed. Keys that there aren't change nothing."""
    marks = chosen.select(F.col(key).alias("__key"), F.lit(True).alias("__set")).distinct()
    both = rows.join(marks, F.col(key) == F.col("__key"), "left")
    changed = F.when(F.col("__set"), value).otherwise(F.col(column)).cast(rows.schema[column].dataType)
    return both.withColumn(column, changed).select(*rows.columns)


def list_outline(outline: DataFrame) -> DataFrame:
    """Outlines by document, page and title."""
    return outline.orderBy("doc_id", F.asc_nulls_first("page"), "title")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbours of graph nodes (``node``), the strongest first, links before similar ones: ``node``, ``neighbour``, ``strength``,
    ``place``. ``edges``: ``a``, ``b``, ``kind``, ``weight``, in either direction; of several edges to a neighbour the strongest counts."""
    strength = F.col("weight") + F.when(F.col("kind") == "link", LINK_LEAD).otherwise(0.0)
    ends = F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("node"), F.col("a").alias("neighbour"))))
    both = edges.filter("a <> b").withColumn("strength", strength).select(ends, "strength")
    best = both.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node", "neighbour").agg(F.max("strength").alias("strength"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("strength"), "neighbour")))


def children(nodes: DataFrame, of: DataFrame, key: str = "id") -> DataFrame:
    """Nodes of a conversation (``id``, ``parents``) that stem from those of ``of``: ``parent`` and the child's columns."""
    wanted = of.select(F.col(key).alias("parent")).distinct()
    return nodes.withColumn("parent", F.explode(F.array_distinct("parents"))).join(wanted, "parent", "left_semi")


def check_ids(chunks: DataFrame, most: int = 10, key: str = "vector_id") -> DataFrame:
    """A spread of ids to check: every ``n / most``-th in order, ``most`` at most.

    Ids are counted in ranges first, so only the ranges' numbers of rows meet in one place.
    """
    dealt = chunks.select(key).repartitionByRange(key).withColumn("part", F.spark_partition_id())
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per range
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    placed = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1).join(F.broadcast(before), "part")
    step = F.greatest(F.lit(1), F.floor(F.col("total") / most))
    at = F.col("before") + F.col("at")
    return placed.filter((at % step == 0) & (at < step * most)).select(key)


def verify(chunks: DataFrame, indexed: DataFrame, deep: bool = False, key: str = "vector_id") -> DataFrame:
    """One row: ``n_chunks``, ``n_indexed``, ``checked``, ``missing`` (checked ids that aren't indexed) and ``ok``. A check that isn't
    ``deep`` looks for :func:`check_ids` only."""
    ids = chunks.select(key) if deep else check_ids(chunks, key=key)
    known = indexed.select(F.col(key).alias("__id"), F.lit(1).alias("__there")).dropDuplicates(["__id"])
    looked = ids.join(known, F.col(key) == F.col("__id"), "left").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("__there").isNull()).alias("missing"))
    sizes = chunks.agg(F.count(F.lit(1)).alias("n_chunks")).join(indexed.agg(F.count(F.lit(1)).alias("n_indexed")), F.lit(True))  # a row each
    ok = (F.col("n_chunks") == F.col("n_indexed")) & (F.col("missing") == 0)
    return sizes.join(looked, F.lit(True)).select("n_chunks", "n_indexed", "checked", "missing", ok.alias("ok"))


def refetched(old: DataFrame, fetched: DataFrame) -> DataFrame:
    """Documents fetched again, with the tags that their users gave them before; ``old``: ``doc_id``, ``tags``."""
    tags = old.select("doc_id", F.col("tags").alias("__tags")).dropDuplicates(["doc_id"])
    return fetched.join(tags, "doc_id", "left").withColumn("tags", F.coalesce("__tags", "tags")).select(*fetched.columns)


def append_notes(documents: DataFrame, notes: DataFrame, source: str = "HTTP") -> DataFrame:
    """Documents (``doc_id``, ``notes_md``, ...) with notes (``doc_id``, ``note``, ``at``) behind those they have, in the order of their time.
    Notes of unknown documents change nothing; a document without notes begins with them."""
    block = F.concat(F.lit("\n---\n_"), F.col("at").cast("string"), F.lit(f" (added via {source})_\n\n"), F.col("note"), F.lit("\n"))
    listed = F.array_sort(F.collect_list(F.struct("at", block.alias("block"))))
    more = notes.filter("note is not null").groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["block"]), "").alias("__more"))
    whole = F.when(F.col("__more").isNull(), F.col("notes_md")).otherwise(F.concat(F.coalesce("notes_md", F.lit("")), "__more"))
    return documents.join(more, "doc_id", "left").withColumn("notes_md", whole).select(*documents.columns)


def reflection_id(title: Column, own: Column | None = None) -> Column:
    """A reflection's id: its own, else the title's slug with ``reflection-`` before it unless it begins so; null for a title without a
    letter or digit."""
    name = slug(title)
    made = F.when(F.startswith(name, F.lit("reflection-")), name).otherwise(F.concat(F.lit("reflection-"), name))
    return made if own is None else F.coalesce(own, made)


def as_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Each row, nested columns and all, as one JSON text; null fields are kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(column))
