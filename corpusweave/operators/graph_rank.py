"""Rank lists by personalised PageRank over the neighbourhood of each query's seeds.

A query's seeds are its dense hits. Each seed brings its nearest chunks as nodes, with edges by cosine; documents that
link to each other connect those of their chunks that are nodes by then. Rank spreads over that small graph. So the
neighbours are found once per distinct seed chunk, however many queries share it, and a query's graph has no more nodes than
its seeds times ``neighbors + 1``, however large the corpus is. The rounds of one query run in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .vectors import knn_join

#: Nearest chunks per seed, damping and rounds; and the weight that a link of documents has.
NEIGHBORS, DAMPING, ROUNDS, LINK_WEIGHT = 8, 0.5, 15, 1.0


def seed_edges(seeds: DataFrame, chunks: DataFrame, neighbors: int = NEIGHBORS, allow: DataFrame | None = None, **knn) -> DataFrame:
    """``query_id``, ``src``, ``dst``, ``weight``: from each seed (``query_id``, ``vector_id``) to the ``neighbors + 1`` chunks
    nearest to it, of which it is one itself; loops and cosines of 0 or less are dropped. Seeds without a vector bring none.
    ``knn``: further arguments of :func:`.vectors.knn_join`."""
    asked = chunks.join(seeds.select("vector_id").distinct(), "vector_id", "left_semi").select(F.col("vector_id").alias("src"), "embedding")
    near = knn_join(asked, chunks.select("vector_id", "embedding"), max(1, neighbors + 1), "src", "vector_id", allow=allow, **knn)
    near = near.filter("cos > 0 and src <> vector_id").select("src", F.col("vector_id").alias("dst"), F.col("cos").alias("weight"))
    return seeds.select("query_id", F.col("vector_id").alias("src")).distinct().join(near, "src").select("query_id", "src", "dst", "weight")


def _spread(damping: float, rounds: int, nodes: pa.Table, edges: pa.Table) -> pa.Table:
    """PageRank of one query. ``nodes``: ``node``, ``doc``, ``links`` and ``p``, the mass that it starts with."""
    ids = nodes["node"].to_pylist()
    place = {x: k for k, x in enumerate(ids)}
    n, start = len(ids), nodes["p"].to_numpy()
    a, b = (np.fromiter((place[x] for x in edges[c].to_pylist()), np.int64, len(edges)) for c in ("src", "dst"))
    weight = edges["weight"].to_numpy()
    src, dst, weight = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weight, weight])
    # Links go from every node of a document to every node of another: their sums per document do for all these pairs.
    number: dict = {}
    doc = np.fromiter((number.setdefault(x, len(number)) for x in nodes["doc"].to_pylist()), np.int64, n)
    linked: dict = dict(zip(nodes["doc"].to_pylist(), nodes["links"].to_pylist()))
    pairs = [(number[x], number[y]) for x, ys in linked.items() for y in ys or [] if x is not None and y in number]
    both = np.array([*pairs, *((y, x) for x, y in pairs)], np.int64).reshape(-1, 2)
    size = len(number)
    loops = np.bincount(both[both[:, 0] == both[:, 1], 0], minlength=size) * LINK_WEIGHT  # a node has no link to itself

    def inflow(share: np.ndarray) -> np.ndarray:
        per_doc = np.bincount(doc, share, size)
        by_link = LINK_WEIGHT * np.bincount(both[:, 1], per_doc[both[:, 0]], size)
        return np.bincount(dst, share[src] * weight, n) + by_link[doc] - loops[doc] * share

    degree = inflow(np.ones(n))  # weights are the same both ways
    mass = start
    for _ in range(max(1, rounds)):
        share = np.divide(mass, degree, out=np.zeros(n), where=degree > 0)
        mass = (1 - damping) * start + damping * inflow(share)
        total = mass.sum()
        mass = mass / total if total > 0 else mass
    return pa.table({"query_id": nodes["query_id"], "node": nodes["node"], "mass": pa.array(mass)})


def ppr_rank(
    seeds: DataFrame,
    chunks: DataFrame,
    links: DataFrame,
    neighbors: int = NEIGHBORS,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    allow: DataFrame | None = None,
    **knn,
) -> DataFrame:
    """Every node of each query's graph by falling mass, ties to the smaller id: ``query_id``, ``vector_id``, ``score``, ``rank``.

    ``seeds``: ``query_id``, ``vector_id``, ``cos``; they start with mass by their cosine, those of 0 or less with none, and a
    query without any mass has no list. ``chunks``: ``vector_id``, ``doc_id``, ``embedding``. ``links``: ``doc_id`` and ``links``, an
    array of documents; each listing of a link counts. An edge found from both sides, or by a link as well, weighs the sum.
    Seeds without an edge are no nodes. ``allow``: chunks (``vector_id``) that neighbours are taken from. ``damping`` is kept
    within 0 and 0.99. Scores are rounded to 9 digits.
    """
    damping = min(0.99, max(0.0, damping))
    given = seeds.groupBy("query_id", F.col("vector_id").alias("node")).agg(F.sum(F.greatest(F.lit(0.0), "cos")).alias("own"))
    given = given.withColumn("total", F.sum("own").over(Window.partitionBy("query_id"))).filter("total > 0")
    # Both are small and read more than once: searches behind them run once.
    given = cut(given.select("query_id", "node", (F.col("own") / F.col("total")).alias("p")))
    edges = cut(seed_edges(given.select("query_id", F.col("node").alias("vector_id")), chunks, neighbors, allow, **knn))
    ends = edges.select("query_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    about = chunks.select(F.col("vector_id").alias("node"), F.col("doc_id").alias("doc")).join(
        links.select(F.col("doc_id").alias("doc"), "links"), "doc", "left"
    )
    nodes = ends.join(about, "node").join(given, ["query_id", "node"], "left").select("query_id", "node", "doc", "links", F.coalesce("p", F.lit(0.0)).alias("p"))
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in ("query_id", "node")}
    own_edges = edges.withColumnRenamed("query_id", "edge_query")
    spread = nodes.groupBy("query_id").cogroup(own_edges.groupBy("edge_query")).applyInArrow(
        lambda x, y: _spread(damping, rounds, x, y), f"query_id {kinds['query_id']}, node {kinds['node']}, mass double"
    )
    scored = spread.select("query_id", F.col("node").alias("vector_id"), F.round("mass", 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vector_id")
    return scored.withColumn("rank", F.row_number().over(order))
