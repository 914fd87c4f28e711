"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name,
different blocks different names. Then adjacent pairs of names are named in the same way, level by level,
until each document is down to one name. Two documents end with the same (level, name) exactly if their
texts are equal, so that pair is an identity without collisions.

Naming a level: the distinct keys are sorted inside the partitions of a hash shuffle and numbered in that
order, so a task that is run again gives the same names. Blocks travel through a shuffle once: they are
grouped by a 64-bit hash, and the smallest and largest block of each hash show whether it stands for one
block only. Where it doesn't, those few blocks are numbered by their content.

Skew: every grouping here is a partial aggregate, and occurrences meet their names in plain joins, which
adaptive execution splits; no group of copies is gathered in a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

BLOCK_BYTES = 4096


def _numbered(keys: DataFrame, *order: str) -> DataFrame:
    """Distinct keys with an integer ``name`` from their sorted place in their partition."""
    return keys.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _blocks(docs: DataFrame, id_col: str, text_col: str, normalise, block_bytes: int, hash_bits: int) -> DataFrame:
    norm = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.encode(norm, "UTF-8").alias("raw"),
    ).withColumns(
        {
            "sha": F.sha2("raw", 256),
            "n": F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / F.lit(block_bytes))).cast("int"),
        }
    )
    cut = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes)),
    )
    out = rows.select("row", "id", "sha", "n", F.posexplode(cut).alias("pos", "block"))
    first = F.col("pos") == 0
    return out.select(
        "row",
        "pos",
        "n",
        F.when(first, F.col("id")).alias("id"),
        F.when(first, F.col("sha")).alias("sha"),
        "block",
        F.shiftright(F.xxhash64("block"), 64 - hash_bits).alias("h") if hash_bits < 64 else F.xxhash64("block").alias("h"),
    )


def name_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=ascii_lower,
    block_bytes: int = BLOCK_BYTES,
    hash_bits: int = 64,
) -> DataFrame:
    """One row per input row: ``row`` (its number here), ``id``, ``sha`` (SHA-256 of the normalised text),
    ``level`` and ``name``; (level, name) is the identity of the text.

    Null text counts as empty. ``hash_bits`` below 64 makes collisions of block hashes likely, for tests.
    """
    blocks = _blocks(docs, id_col, text_col, normalise, block_bytes, hash_bits)
    per_hash = stage(
        blocks.groupBy("h")
        .agg(F.min("block").alias("low"), F.max("block").alias("high"))
        .select("h", (F.col("low") != F.col("high")).alias("many")),
        "block-hashes",
    )
    plain = _numbered(per_hash.filter(~F.col("many")).select("h"), "h")
    named = blocks.select("row", "pos", "n", "id", "sha", "h").join(plain, "h")
    clash = per_hash.filter("many").select("h")
    if not clash.isEmpty():
        # Even numbers for these, odd ones for the rest.
        some = blocks.join(F.broadcast(clash) if hash_bits == 64 else clash, "h", "left_semi")
        extra = _numbered(some.select("h", "block").distinct(), "h", "block")
        some = some.join(extra, ["h", "block"]).withColumn("name", F.col("name") * 2)
        named = named.withColumn("name", F.col("name") * 2 + 1).select("row", "pos", "n", "id", "sha", "name")
        named = named.unionByName(some.select("row", "pos", "n", "id", "sha", "name"))
    seq = stage(named.select("row", "pos", "n", "id", "sha", "name"), "block-names")
    done = None
    level = 0
    most = seq.agg(F.max("n")).first()[0] or 1
    while True:
        ended = seq.filter("n = 1").select("row", "id", "sha", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        if most <= 1:
            return done
        even = F.col("pos") % 2 == 0
        pairs = (
            seq.filter("n > 1")
            .groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("at"))
            .agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
                F.max("n").alias("n"),
                F.max("id").alias("id"),
                F.max("sha").alias("sha"),
            )
        )
        pairs = stage(pairs, "pairs")
        names = stage(_numbered(pairs.select("a", "b").distinct(), "a", "b"), "pair-numbers")
        seq = stage(
            pairs.join(names, ["a", "b"]).select(
                "row", F.col("at").alias("pos"), F.ceil(F.col("n") / 2).cast("int").alias("n"), "id", "sha", "name"
            ),
            "pair-names",
        )
        most = (most + 1) // 2
        level += 1


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=ascii_lower,
    block_bytes: int = BLOCK_BYTES,
    hash_bits: int = 64,
) -> DataFrame:
    """Which row of each group of equal texts stays: the one with the largest id.

    Returns one row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    * Null text counts as empty; all empty texts are one group. Texts of any length are read whole.
    * A null id is smaller than any other; in a group of null ids only, ``keep_id`` is null.
    * Rows that share both id and text: one of them is kept (the last in input order), the others not.
    * An empty table gives an empty result. Further columns of ``docs``, whatever their names, are ignored.
    """
    named = name_documents(docs, id_col, text_col, normalise, block_bytes, hash_bits)
    groups = stage(  # staged, so that the join below shuffles both sides and can split a large group
        named.groupBy("level", "name").agg(
            F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
        ),
        "copy-groups",
    )
    kept: Column = F.col("keep.row") == F.col("row")
    return named.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        kept.alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def dedup_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=ascii_lower) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, all columns kept (stage of the pipeline).

    Rows that share both id and text are repeats of one document and count once before that.
    """
    docs = docs.withColumn("__sha", F.sha2(F.encode(normalise(F.coalesce(F.col(text_col), F.lit(""))), "UTF-8"), 256))
    dropped = (
        exact_dedup(docs.select(id_col, text_col), id_col, text_col, normalise)
        .groupBy(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__of"))
        .agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__n"))
        .filter("not __kept or __n > 1")
    )
    marked = docs.join(dropped, docs[id_col].eqNullSafe(dropped["__id"]) & (docs["__sha"] == dropped["__of"]), "left")
    once = marked.filter("__kept is null").drop("__sha", "__id", "__of", "__kept", "__n")
    repeated = marked.filter("__kept").drop("__id", "__of", "__kept", "__n").dropDuplicates([id_col, "__sha"]).drop("__sha")
    return once.unionByName(repeated)
