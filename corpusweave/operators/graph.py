"""Similar documents, the corpus graph, hubs, surprise edges and personalised PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import knn_join

NEEDS = ("future_work", "limitations")
SOLUTIONS = ("method", "experiments", "applications")


def best_per_document(hits: DataFrame, query: str, k: int) -> DataFrame:
    """Largest cosine per (``query``, ``doc_id``), the best ``k`` documents; ties to the smaller id."""
    best = hits.groupBy(query, "doc_id").agg(F.max("cos").alias("score"))
    order = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", order.cast("long")).filter(F.col("rank") <= k)


def undirected(links: DataFrame, similar: DataFrame) -> DataFrame:
    """One edge per pair: a link beats a similarity, of similarities the largest weight stays.

    ``links``: ``src``, ``dst``. ``similar``: ``src``, ``dst``, ``weight``. Loops are dropped.
    """
    both = links.select("src", "dst", F.lit(1.0).alias("weight"), F.lit(1).alias("is_link")).unionByName(
        similar.select("src", "dst", "weight", F.lit(0).alias("is_link"))
    )
    return (
        both.filter("src <> dst")
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.max(F.struct("is_link", "weight")).alias("e"))
        .select("a", "b", F.when(F.col("e.is_link") == 1, "link").otherwise("similar").alias("kind"), F.col("e.weight").alias("weight"))
    )


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def category_distance(a: Column, b: Column) -> Column:
    """Jaccard distance of two sets; null if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 1.0 - both / F.size(F.array_union(a, b)))


def surprise_edges(pairs: DataFrame, min_similarity: float, min_distance: float = 1.0) -> DataFrame:
    """Edges from chunk pairs (``x_*`` and ``y_*``: id, doc, section, categories; ``cos``).

    ``need_solution`` goes from a need to a solution, whichever side asked; ``cross_domain`` from the smaller id.
    A pair may earn both; an edge found from both sides is one edge.
    """
    close = pairs.filter((F.col("cos") >= min_similarity) & (F.col("x_doc") != F.col("y_doc")))
    close = close.withColumn("distance", category_distance(F.col("x_categories"), F.col("y_categories")))

    def edge(p: str, q: str, kind: str, surprise: Column) -> Column:
        ends = [F.col(f"{side}_{what}").alias(f"{end}_{name}") for what, name in (("id", "chunk"), ("doc", "doc")) for side, end in ((p, "src"), (q, "dst"))]
        return F.struct(*ends, F.lit(kind).alias("kind"), F.col("cos").alias("similarity"), surprise.alias("surprise"))

    needs = lambda p, q: F.col(f"{p}_section").isin(*NEEDS) & F.col(f"{q}_section").isin(*SOLUTIONS)
    far, surprise = F.col("distance") >= min_distance, F.round(F.col("cos") * F.col("distance"), 6)
    earned = F.array(
        F.when(needs("x", "y"), edge("x", "y", "need_solution", F.col("cos"))),
        F.when(needs("y", "x"), edge("y", "x", "need_solution", F.col("cos"))),
        F.when(far & (F.col("x_id") < F.col("y_id")), edge("x", "y", "cross_domain", surprise)),
        F.when(far & (F.col("x_id") > F.col("y_id")), edge("y", "x", "cross_domain", surprise)),
    )
    return close.select(F.inline(F.array_compact(earned))).dropDuplicates(["src_chunk", "dst_chunk", "kind"])


def edge_pairs(chunks: DataFrame, neighbors: int, changed: DataFrame | None = None, **knn) -> DataFrame:
    """What :func:`surprise_edges` reads: each chunk (``vector_id``, ``doc_id``, ``section_type``, ``categories``, ``embedding``) with
    its nearest ``neighbors`` of other documents. With ``changed`` (``doc_id``) only chunks of those documents ask.
    ``knn``: further arguments of :func:`.vectors.knn_join`."""
    asking = chunks if changed is None else chunks.join(changed.select("doc_id").distinct(), "doc_id", "left_semi")
    named = {"vector_id": "id", "doc_id": "doc", "section_type": "section", "categories": "categories"}
    side = lambda rows, p: rows.select(*(F.col(c).alias(f"{p}_{n}") for c, n in named.items()))
    vectors = lambda rows, p: rows.select(F.col("vector_id").alias(f"{p}_id"), F.col("doc_id").alias(f"{p}_doc"), "embedding")
    near = knn_join(vectors(asking, "x"), vectors(chunks, "y"), neighbors, "x_id", "y_id", "x_doc", "y_doc", **knn)
    return near.join(side(asking, "x"), "x_id").join(side(chunks, "y"), "y_id")


def refreshed_edges(edges: DataFrame, changed: DataFrame, pairs: DataFrame, min_similarity: float, min_distance: float = 1.0) -> DataFrame:
    """``edges`` brought up to date for documents that ``changed`` (``doc_id``) or are gone: those with an end in one go, those
    of ``pairs`` (:func:`edge_pairs` with the same ``changed``) come. Edges that only chunks of other documents would find come
    with the next full build."""
    kept = drop_incident(edges, changed)
    return kept.unionByName(surprise_edges(pairs, min_similarity, min_distance).select(*kept.columns)).dropDuplicates(["src_chunk", "dst_chunk", "kind"])


def drop_incident(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges without an end in ``docs`` (``doc_id``)."""
    gone = docs.select(F.col("doc_id").alias("gone")).distinct()
    return edges.join(gone, F.col("src_doc") == F.col("gone"), "left_anti").join(gone, F.col("dst_doc") == F.col("gone"), "left_anti")


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.5, rounds: int = 15, cut=None) -> DataFrame:
    """Personalised PageRank of every graph at once: ``query_id``, ``node``, ``rank_mass``.

    ``edges``: ``query_id``, ``src``, ``dst``, ``weight``; repeated edges add up, loops and weights of 0 or less
    are dropped, both directions count. ``seeds``: ``query_id``, ``node``, ``weight``, normalised per query; seeds
    without edges are dropped. Each round renormalises. ``cut``, a function of a DataFrame, shortens the lineage
    every five rounds (``DataFrame.checkpoint`` by default).
    """
    cut = cut or (lambda df: df.checkpoint())
    damping = min(0.99, max(0.0, damping))
    real = edges.filter("src <> dst and weight > 0")
    both = real.select("query_id", "src", "dst", "weight").unionByName(
        real.select("query_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    summed = both.groupBy("query_id", "src", "dst").agg(F.sum("weight").alias("weight"))
    out = F.sum("weight").over(Window.partitionBy("query_id", "src"))
    steps = cut(summed.withColumn("share", F.col("weight") / out).select("query_id", "src", "dst", "share"))
    nodes = steps.select("query_id", F.col("src").alias("node")).distinct()
    given = seeds.filter("weight > 0").groupBy("query_id", "node").agg(F.sum("weight").alias("weight")).join(nodes, ["query_id", "node"], "left_semi")
    total = F.sum("weight").over(Window.partitionBy("query_id"))
    start = nodes.join(given.withColumn("p", F.col("weight") / total).drop("weight"), ["query_id", "node"], "left").fillna(0.0, ["p"])
    start = cut(start)
    mass = start.withColumn("r", F.col("p"))
    for k in range(rounds):
        flow = (
            mass.select("query_id", F.col("node").alias("src"), "r")
            .join(steps, ["query_id", "src"])
            .groupBy("query_id", F.col("dst").alias("node"))
            .agg(F.sum(F.col("r") * F.col("share")).alias("inflow"))
        )
        moved = start.join(flow, ["query_id", "node"], "left").withColumn(
            "raw", (1 - damping) * F.col("p") + damping * F.coalesce("inflow", F.lit(0.0))
        )
        whole = F.sum("raw").over(Window.partitionBy("query_id"))
        mass = moved.select("query_id", "node", "p", F.when(whole > 0, F.col("raw") / whole).otherwise(0.0).alias("r"))
        if k % 5 == 4:
            mass = cut(mass)
    return mass.select("query_id", "node", F.col("r").alias("rank_mass"))
