"""Context for readers and chat: sources, drafts, evidence, ancestors, convergence, scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import char_snippet, json_object


def rag_context(hits: DataFrame, k: int = 12, query: str = "query_id") -> DataFrame:
    """Numbered blocks of the ``k`` best hits (``score``, ``vector_id``, ``title``, ``section_type``, ``text``) and
    their sources, per query. ``k`` is clamped to 1..40."""
    k = min(40, max(1, k))
    order = Window.partitionBy(query).orderBy(F.desc("score"), "vector_id")
    top = hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    block = F.format_string('[%d] "%s" — %s section\n%s', "n", "title", "section_type", "text")
    listed = F.array_sort(F.collect_list(F.struct("n", block.alias("block"), "vector_id")))
    return top.groupBy(query).agg(
        F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n").alias("context"),
        F.transform(listed, lambda x: x["vector_id"]).alias("sources"),
    )


def draft_context(hits: DataFrame, budget: int = 3000, query: str = "query_id") -> DataFrame:
    """Hits in order until their blocks exceed ``budget`` bytes; the block that crosses it is the last."""
    block = F.concat(F.lit('From "'), "title", F.lit('": '), "text")
    before = Window.partitionBy(query).orderBy(F.desc("score"), "vector_id").rowsBetween(Window.unboundedPreceding, -1)
    sized = hits.withColumn("block", block).withColumn("used", F.coalesce(F.sum(F.octet_length("block")).over(before), F.lit(0)))
    return sized.filter(F.col("used") <= budget)


def evidence(hits: DataFrame, n: int = 3, snippet: int = 240, query: str = "query_id") -> DataFrame:
    """The top chunk of each of the first ``n`` documents, as a snippet."""
    own = Window.partitionBy(query, "doc_id").orderBy("rank")
    first = hits.withColumn("__k", F.row_number().over(own)).filter("__k = 1")
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "rank"))
    return first.withColumn("place", place.cast("long")).filter(F.col("place") <= n).select(query, "place", "doc_id", "vector_id", char_snippet(F.col("text"), snippet).alias("snippet"))


def ancestors(nodes: DataFrame, cut=None) -> DataFrame:
    """All transitive parents of every node: ``id``, ``ancestor``. ``nodes``: ``id``, ``parents`` (array).

    The frontier is joined with the parents until nothing new comes; ``cut`` shortens the lineage of each step
    (``DataFrame.checkpoint`` by default). Cycles end, as pairs are found once.
    """
    cut = cut or (lambda df: df.checkpoint())
    up = cut(nodes.select("id", F.explode("parents").alias("ancestor")).distinct())
    found, frontier = up, up
    while True:
        step = frontier.join(up.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor")
        frontier = cut(step.select("id", F.col("next").alias("ancestor")).distinct().join(found, ["id", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def history(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Usable ancestor turns, oldest first: ``id``, ``turns``. Failed and blank turns, and system roles, are out."""
    turns = nodes.select(F.col("id").alias("ancestor"), "role", "text", "status", "created_at").filter(
        F.col("role").isin("user", "assistant") & (F.coalesce("status", F.lit("ok")) != "error") & (F.trim("text") != "")
    )
    listed = F.array_sort(F.collect_list(F.struct("created_at", "ancestor", "role", "text")))
    return pairs.join(turns, "ancestor").groupBy("id").agg(F.transform(listed, lambda x: F.struct(x["role"], x["text"])).alias("turns"))


def convergence(turns: DataFrame, similarity, threshold: float = 0.90) -> DataFrame:
    """Per conversation and round the mean similarity of each agent's turn to its last one, and the first round
    that reaches ``threshold``. ``turns``: ``conv_id``, ``agent``, ``round``, ``embedding``; ``similarity`` takes
    two array columns."""
    last = F.lag("embedding").over(Window.partitionBy("conv_id", "agent").orderBy("round"))
    scored = turns.withColumn("before", last).filter("before is not null")
    mean = scored.groupBy("conv_id", "round").agg(F.round(F.avg(similarity(F.col("embedding"), F.col("before"))), 6).alias("similarity"))
    done = F.min(F.when(F.col("similarity") >= threshold, F.col("round"))).over(Window.partitionBy("conv_id"))
    return mean.withColumn("converged_at", done)


def scorecards(replies: DataFrame, criteria: list[str]) -> DataFrame:
    """Mean of each criterion per agent, from JSON objects inside prose; values are clamped to 0..10, and a reply
    that lacks one doesn't count."""
    parsed = replies.withColumn("s", json_object(F.col("text"), ", ".join(f"{c} double" for c in criteria)))
    whole = None
    for c in criteria:
        whole = F.col(f"s.{c}").isNotNull() if whole is None else whole & F.col(f"s.{c}").isNotNull()
    clamp = lambda c: F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.col(f"s.{c}")))
    return parsed.filter(whole).groupBy("agent").agg(*(F.round(F.avg(clamp(c)), 6).alias(c) for c in criteria))
