"""Corpus jobs: embedding cache, upserts, removal, clean-up and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CACHE_KEY = ["content_hash", "model", "version"]


def split_cache(chunks: DataFrame, cache: DataFrame, model: str, version: int) -> tuple[DataFrame, DataFrame]:
    """Chunks with their cached vectors, and the distinct hashes and texts that have none."""
    own = cache.filter((F.col("model") == model) & (F.col("version") == version)).select("content_hash", "embedding")
    hits = chunks.join(own, "content_hash")
    misses = chunks.join(own, "content_hash", "left_anti").dropDuplicates(["content_hash"]).select("content_hash", "text")
    return hits, misses


def hashed_embedding(text_df: DataFrame, dim: int = 64, key: str = "content_hash", text: str = "text") -> DataFrame:
    """A deterministic embedding without a model: signed hashed words, at unit length; blank texts give zeros."""
    words = text_df.select(key, F.explode(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")).alias("w"))
    h = F.xxhash64("w")
    parts = words.groupBy(key, F.pmod(h, F.lit(dim)).cast("int").alias("at")).agg(F.sum(F.when(h.bitwiseAND(1 << 40) == 0, 1.0).otherwise(-1.0)).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    entries = parts.withColumn("x", F.when(length > 0, F.col("x") / length).otherwise(0.0)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)).cast("float"))
    return text_df.select(key).distinct().join(entries, key, "left").withColumn("m", F.coalesce("m", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>")))).select(key, dense.alias("embedding"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it doesn't have; of equal keys in ``new`` one row."""
    fresh = new.dropDuplicates(keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def upsert_candidates(old: DataFrame, new: DataFrame, key: str = "cand_id") -> DataFrame:
    """Guarded upsert: absent keys come in as new; present ones are refreshed while their status is still new.

    Of equal keys in ``new`` the highest score counts. Status and first sight are never overwritten.
    """
    best = Window.partitionBy(key).orderBy(F.desc("score"), *[c for c in new.columns if c not in (key, "score")])
    source = new.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")
    values = [c for c in new.columns if c != key]
    renamed = source.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in values))
    both = old.join(renamed, F.col(key) == F.col("__key"), "full_outer")
    inserted, refreshed = F.col(key).isNull(), (F.col("status") == "new") & F.col("__key").isNotNull()
    out = [F.coalesce(key, "__key").alias(key)]
    for c in old.columns:
        if c == "status":
            out.append(F.when(inserted, "new").otherwise(F.col("status")).alias("status"))
        elif c == "first_seen_at":
            out.append((F.when(inserted, F.col("__first_seen_at")).otherwise(F.col(c)) if c in values else F.col(c)).alias(c))
        elif c in values:
            out.append(F.when(inserted | refreshed, F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        elif c != key:
            out.append(F.col(c))
    return both.select(*out, inserted.alias("inserted"))


def edit_tags(tags, add, remove):
    """Tags with some added and some removed, sorted and distinct (array columns)."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_except(F.array_union(F.coalesce(tags, empty), add), remove)))


def merge_notes(old: DataFrame, new: DataFrame, keep_links: bool, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Upsert of ideas or reflections by id, and the rejected rows whose id belongs to another kind.

    Empty tags (and links, with ``keep_links``) leave the old ones; the first ingest time stays.
    """
    owner = old.select(F.col(key).alias("__k"), F.col("kind").alias("__kind"), F.col("tags").alias("__tags"), F.col("links").alias("__links"), F.col("ingested_at").alias("__at"))
    both = new.join(owner, F.col(key) == F.col("__k"), "left")
    foreign = F.col("__k").isNotNull() & (F.coalesce("__kind", F.lit("paper")) != F.col("kind"))
    rejected = both.filter(foreign).select(key, "kind", F.col("__kind").alias("owner_kind"))
    kept = both.filter(~foreign)
    kept = kept.withColumn("tags", F.when(F.size("tags") == 0, F.coalesce("__tags", "tags")).otherwise(F.col("tags")))
    if keep_links:
        kept = kept.withColumn("links", F.when(F.size("links") == 0, F.coalesce("__links", "links")).otherwise(F.col("links")))
    kept = kept.withColumn("ingested_at", F.coalesce("__at", "ingested_at")).select(*new.columns)
    return replace_by_key(old.select(*new.columns), kept, [key]), rejected


def consistency(chunks: DataFrame, edges: DataFrame, dim: int, docs: DataFrame | None = None) -> DataFrame:
    """Counts of what doesn't fit: ``problem``, ``n``. With ``docs`` (``doc_id``) chunks of other documents are told too."""
    ids = chunks.select(F.col("vector_id").alias("id"))
    lost = lambda end: edges.join(ids, F.col(end) == F.col("id"), "left_anti").select(F.lit(f"{end} without chunk").alias("problem"))
    found = chunks.filter("embedding is null").select(F.lit("no embedding").alias("problem"))
    found = found.unionByName(chunks.filter(F.size("embedding") != dim).select(F.lit("wrong length").alias("problem")))
    found = found.unionByName(lost("src_chunk")).unionByName(lost("dst_chunk"))
    if docs is not None:
        found = found.unionByName(orphans(chunks, docs, "doc_id").select(F.lit("document gone").alias("problem")))
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def main_source(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document the main file (``name``, ``body``): those with a document class first, by preferred name, then
    those that begin a document, then the largest."""
    has_class = F.contains("body", F.lit("\\documentclass"))
    stem = F.lower(F.regexp_replace(F.regexp_extract("name", r"([^/]*)$", 1), r"\.[^.]*$", ""))
    named = F.when(stem == "main", 0).when(stem == "paper", 1).when(stem == "manuscript", 2).otherwise(3)
    order = Window.partitionBy(key).orderBy(F.desc(has_class), named, F.desc(F.contains("body", F.lit("\\begin{document}"))), F.desc(F.octet_length("body")), "name")
    return files.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def quantise(vector, bits: int = 4):
    """A vector's values on an even grid between its extremes: codes, low end and step (struct column)."""
    low, high = F.array_min(vector).cast("double"), F.array_max(vector).cast("double")
    step = F.when(high > low, (high - low) / ((1 << bits) - 1)).otherwise(1.0)
    return F.struct(F.transform(vector, lambda x: F.round((x - low) / step).cast("byte")).alias("codes"), low.alias("low"), step.alias("step"))


def list_documents(docs: DataFrame, kind: str | None = None, project: str | None = None, tag=None, category=None) -> DataFrame:
    """Documents that pass all given filters, by id. A document without a kind is a paper."""
    out = docs
    if kind is not None:
        out = out.filter(F.coalesce("kind", F.lit("paper")) == kind)
    if project is not None:
        out = out.filter(F.col("project") == project)
    for column, value in (("tags", tag), ("categories", category)):
        if value is not None:
            out = out.filter(F.array_contains(column, value))
    return out.orderBy("doc_id")


def find_documents(docs: DataFrame, needle: str) -> DataFrame:
    """Documents (``title``, ``authors``, ``tags``, ``published_at``) with the needle, in any case, in the title, the authors
    or a tag; newest first. A blank needle finds all."""
    low = F.lit(needle.strip().lower())
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), low)
    found = has(F.col("title")) | has(F.array_join("authors", ", ")) | F.exists(F.coalesce("tags", F.array().cast("array<string>")), has)
    return docs.filter(found).orderBy(F.desc("published_at"))


def document_detail(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``docs`` with the ids of their chunks in order (null without any) and whether they have notes."""
    own = chunks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list("vector_id")).alias("chunk_ids"), F.max(F.col("section_type") == "user_notes").alias("has_notes")
    )
    return docs.join(own, "doc_id", "left").withColumn("has_notes", F.coalesce("has_notes", F.lit(False)))


def orphans(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` no owner has: chunks of documents that are gone, cached vectors without a chunk, candidates that are
    new to the corpus, documents without chunks."""
    return rows.join(owners.select(key).distinct(), key, "left_anti")
