"""Embedding of chunks with a cache: only texts that no cached vector stands for go to the embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus
from .lineage import cut

#: A list of texts to as many vectors. It runs inside tasks, so it must be picklable and may open its model when first called.
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]

CACHE_SCHEMA = "content_hash string, model string, version int, embedding array<float>"


def embed_texts(misses: DataFrame, embedder: Embedder, dim: int, batch: int = 128) -> DataFrame:
    """``content_hash`` and ``embedding`` of texts (``content_hash``, ``text``), ``batch`` texts a call.

    An embedder that gives another number of vectors than it was given texts, a vector of another length than ``dim``, or a
    component that isn't finite stops the job: nothing of it gets into a cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                some = rows.slice(at, batch)
                found = list(embedder(some.column("text").to_pylist()))
                if len(found) != some.num_rows:
                    raise ValueError(f"the embedder gave {len(found)} vectors for {some.num_rows} texts")
                for k, v in enumerate(found):
                    if len(v) != dim:
                        raise ValueError(f"the embedder gave a vector of {len(v)} dimensions for text {k}, {dim} are expected")
                vectors = np.asarray(found, np.float32)
                if not np.isfinite(vectors).all():
                    raise ValueError("the embedder gave a vector that isn't finite")
                yield pa.record_batch({"content_hash": some.column("content_hash"), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})

    return misses.select("content_hash", "text").mapInArrow(run, "content_hash string, embedding array<float>")


def embed_with_cache(
    chunks: DataFrame, cache: DataFrame, embedder: Embedder, model: str, version: int, dim: int, batch: int = 128
) -> tuple[DataFrame, DataFrame]:
    """Chunks (``content_hash``, ``text``, further columns) with ``embedding`` and ``cached``, and the new rows of the cache.

    ``cache``: :data:`CACHE_SCHEMA`, one row a key; vectors of another model or version don't count. Each distinct missing text
    is embedded once, whatever the number of chunks that hold it. New rows are written to the shared folder, so that neither
    result embeds anything again; append them to the cache.
    """
    _, misses = corpus.split_cache(chunks, cache, model, version)
    fresh = cut(embed_texts(misses, embedder, dim, batch))
    own = cache.filter((F.col("model") == model) & (F.col("version") == version)).select("content_hash", "embedding", F.lit(True).alias("cached"))
    both = own.unionByName(fresh.withColumn("cached", F.lit(False)))
    rows = fresh.select("content_hash", F.lit(model).alias("model"), F.lit(version).alias("version"), "embedding")
    return chunks.join(both, "content_hash"), rows


def ingest_report(embedded: DataFrame) -> DataFrame:
    """Per document: chunks, and how many of their vectors were cached."""
    return embedded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.col("cached").cast("long")).alias("cache_hits"))
