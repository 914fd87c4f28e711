"""Vector expressions and the k-nearest-neighbour join: exact in blocks, or through an index (:mod:`.vector_index`)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block on either side: a pair of blocks needs 8 bytes for each pair of rows at once.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for vectors of different lengths or without length, null for null."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def normalised(a: Column) -> Column:
    """The vector at unit length; a zero vector as it is."""
    length = norm(a)
    return F.when(length == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / length))


#: Components this large are refused, as their products lose all precision.
TOO_LARGE = 1e16


def measure(df: DataFrame, vector: str = "embedding") -> tuple[int, int | None]:
    """Rows with a vector, and the vectors' length; vectors of several lengths, and those with a component that is null, not
    finite or ``TOO_LARGE``, are a ValueError. One pass over the vectors, whose counts size the blocks."""
    v = F.col(vector)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < TOO_LARGE))
    n, least, most, bad = (
        df.filter(v.isNotNull()).agg(F.count(v), F.min(F.size(v)), F.max(F.size(v)), F.sum((~usable).cast("long"))).first()
    )
    if not n:
        return 0, None
    if least != most:
        raise ValueError(f"vectors of {least} to {most} dimensions")
    if bad:
        raise ValueError(f"{bad} vectors hold a component that can't be searched with")
    return n, most


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows at unit length; zero vectors stay."""
    flat = column.combine_chunks()
    out = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1, length)


def block_top(k: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """For each row of one block its ``k`` best of the other: cosines rounded to 6 digits, ties to the smaller id."""
    take_l, take_r, cos = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if len(left) and len(right):
        scores = np.round(matrix(left["l_vec"]) @ matrix(right["r_vec"]).T, 6)
        if "l_skip" in left.column_names:
            scores[left["l_skip"].to_numpy()[:, None] == right["r_skip"].to_numpy()[None, :]] = -np.inf
        if scores.shape[1] > k:  # rows that tie with the k-th are all considered
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
            i, j = np.nonzero((scores >= least) & np.isfinite(scores))
        else:
            i, j = np.nonzero(np.isfinite(scores))
        place = np.empty(len(right), np.int64)  # of an id among the block's
        place[np.argsort(right["r_id"].to_numpy(), kind="stable")] = np.arange(len(right))
        order = np.lexsort((place[j], -scores[i, j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        nth = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i)))
        take_l, take_r = i[nth < k], j[nth < k]
        cos = scores[take_l, take_r]
    return pa.table({"l_id": left["l_id"].take(take_l), "r_id": right["r_id"].take(take_r), "cos": pa.array(cos, pa.float64())})


#: Right rows that a left block is compared with at once, and rows of a left block at least where there are tasks for more.
STEP, LEAST_BLOCK = 2048, 1024


def dealing(n_left: int, n_right: int, tasks: int, block: int) -> tuple[int, int]:
    """Blocks of the left side and shares of the right one: as many pairs as keep all tasks busy. Every share gives ``k`` rows for
    each left row, so smaller blocks come first. A share is streamed, so its size doesn't matter."""
    blocks = max(1, math.ceil(n_left / block), min(tasks, n_left // LEAST_BLOCK))
    return blocks, max(1, min(math.ceil(tasks / blocks), math.ceil(n_right / block)))


def stream_top(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``k`` best right rows of each row of one left block, as :func:`block_top` has them. Rows come in the order of
    ``side``: the left block first (0), then any number of right rows, of which some are held at a time."""
    left: list[pa.RecordBatch] = []
    unit, best, least = None, None, None

    def merged(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        i, cos = (np.concatenate([x[j] for x in parts]) for j in (0, 1))
        ids = pa.concat_arrays([x[2] for x in parts])
        place = np.empty(len(ids), np.int64)
        place[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
        order = np.lexsort((place, -cos, i))
        order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < k]
        return i[order], cos[order], ids.take(pa.array(order))

    for batch in batches:
        at = int(np.searchsorted(np.asarray(batch.column("side")), 1))
        if at:
            if unit is not None:
                raise RuntimeError("a left row came behind right ones")
            left.append(batch.slice(0, at))
        for start in range(at, batch.num_rows, STEP):
            if not left:
                return
            if unit is None:
                rows = pa.Table.from_batches(left)
                unit, skips = matrix(rows["vec"]), rows["skip"].to_numpy() if "skip" in rows.column_names else None
                least = np.full(len(unit), -np.inf)
            some = batch.slice(start, STEP)
            scores = np.round(unit @ matrix(pa.chunked_array([some.column("vec")])).T, 6)
            if skips is not None:
                scores[skips[:, None] == some.column("skip").to_numpy(zero_copy_only=False)[None, :]] = -np.inf
            if scores.shape[1] > k:
                bound = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
            else:
                bound = least
            i, j = np.nonzero((scores >= bound[:, None]) & np.isfinite(scores))
            found = (i, scores[i, j], some.column("r_id").take(pa.array(j)))
            best = merged([found] if best is None else [best, found])
            full = np.bincount(best[0], minlength=len(unit)) >= k
            lowest = np.full(len(unit), np.inf)
            np.minimum.at(lowest, best[0], best[1])
            least = np.where(full, lowest, -np.inf)
    if best is not None:
        yield pa.record_batch({"l_id": rows["l_id"].combine_chunks().take(pa.array(best[0])), "r_id": best[2], "cos": pa.array(best[1])})


def sides(df: DataFrame, side: str, own_id: str, skip: str | None, vector: str) -> DataFrame:
    """Rows with a vector, under the names that :func:`block_top` reads."""
    named = [F.col(own_id).alias(f"{side}_id"), F.col(vector).alias(f"{side}_vec")]
    return df.filter(F.col(vector).isNotNull()).select(*named, *([F.col(skip).alias(f"{side}_skip")] if skip else []))


def found_schema(left: DataFrame, right: DataFrame) -> str:
    return f"l_id {left.schema['l_id'].dataType.simpleString()}, r_id {right.schema['r_id'].dataType.simpleString()}, cos double"


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every left id, with their ``rank``."""
    order = Window.partitionBy("l_id").orderBy(F.desc("cos"), "r_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_join(
    left: DataFrame,
    right: DataFrame,
    k: int,
    left_id: str,
    right_id: str,
    left_skip: str | None = None,
    right_skip: str | None = None,
    vector: str = "embedding",
    block: int = BLOCK,
    allow: DataFrame | None = None,
    method: str = "blocks",
    **cells,
) -> DataFrame:
    """For each left vector the ``k`` right ones of largest cosine: ``left_id``, ``right_id``, ``cos``, ``rank``.

    Cosines are rounded to 6 digits; ties go to the smaller id. Rows whose ``skip`` values are equal are no neighbours.
    ``allow`` (a table with ``right_id``) lets only its ids be found; an empty one gives nothing, and ids that it alone
    has don't matter. Fewer candidates than ``k`` give as many rows, ``k`` of 0 none. Null vectors have no neighbours;
    vectors of several lengths, and components that aren't finite, are a ValueError.

    ``method="blocks"`` compares each block of left rows with shares of the right side, which a task streams past it; it
    returns ``k`` rows per left row and share. ``method="cells"`` goes through an inverted file of cells (:func:`.vector_index.cell_join`, which takes ``cells``).
    """
    if method == "cells":
        from .vector_index import build_index, cell_join

        index = cells.pop("index", None) or build_index(right, right_id, right_skip, vector, block=block, **cells.pop("build", {}))
        return cell_join(left, index, k, left_id, right_id, left_skip, vector, allow=allow, **cells)
    if method != "blocks":
        raise ValueError(f"no method {method}")
    if allow is not None:
        right = right.join(allow.select(right_id).distinct(), right_id, "left_semi")
    (n_left, dim_left), (n_right, dim_right) = measure(left, vector), measure(right, vector)
    if n_left and n_right and dim_left != dim_right:
        raise ValueError(f"the left vectors have {dim_left} dimensions, the right ones {dim_right}")
    if not n_left or not n_right or k < 1:
        a, b = sides(left, "l", left_id, left_skip, vector), sides(right, "r", right_id, right_skip, vector)
        none = left.sparkSession.createDataFrame([], found_schema(a, b))
        return best_of(none, k).select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id), "cos", "rank")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, shares = dealing(n_left, n_right, tasks, block)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a, b = sides(left, "l", left_id, left_skip, vector), sides(right, "r", right_id, right_skip, vector)
    schema, id_l, id_r = found_schema(a, b), a.schema["l_id"].dataType, b.schema["r_id"].dataType
    named = lambda p: [F.col(f"{p}_vec").alias("vec"), *([F.col(f"{p}_skip").alias("skip")] if left_skip else [])]
    a = a.select(
        F.pmod(F.xxhash64("l_id"), F.lit(blocks)).cast("int").alias("block"), upto(shares).alias("share"), F.lit(0).alias("side"),
        "l_id", F.lit(None).cast(id_r).alias("r_id"), *named("l"),
    )
    b = b.select(
        upto(blocks).alias("block"), F.pmod(F.xxhash64("r_id"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("side"),
        F.lit(None).cast(id_l).alias("l_id"), "r_id", *named("r"),
    )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stream_top(k, batches)

    dealt = a.unionByName(b).repartition("block", "share").sortWithinPartitions("block", "share", "side")
    found = dealt.groupBy("block", "share").applyInArrow(best, schema)
    return best_of(found, k).select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id), "cos", "rank")


def centroids(chunks: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Unit mean vector per key, of vectors of one length; null vectors are left out."""
    sized = chunks.filter(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("pos", "x"))
    mean = sized.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("m"))
    return whole.select(key, normalised(F.transform("m", lambda s: s["x"])).alias(vector))
