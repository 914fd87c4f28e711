"""Clustering around centroids with ns-bounds.

Every vector keeps, for each centroid, the distance at which it last stood from it and the round of that look. The
centroids of all rounds are kept, a few numbers. A stored distance is loosened by how far its centroid has moved in all since
that round (the norm of the total displacement, not the sum of the moves of each round): the centroid can't be
nearer than the distance less that, nor the own one farther than the distance plus that. Centroids that can't be as near as
the own one are passed over; for the others, distances are worked out anew, in whole numbers.

A round is one pass over the vectors, written to the shared folder, and the sums of those that moved. Sums per cluster are
added up in the tasks first, so a large cluster is no hot key; the driver sees a row per cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, stage

#: Whole components lie within plus and minus this, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: Part of a distance by which it may be off in floating point, with a wide margin.
_SLACK = 1e-9
_SMALL = 1 << 20  # up to here, sums of products are exact in floating point for 1,024 components


def integer_vectors(table: DataFrame, size: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``id_col`` and ``v`` (whole numbers ``floor(scale * x)``, x as double) of vectors with exactly ``size`` components, none of
    them null, NaN or infinite; other rows fall away. A component beyond ``LARGEST`` is an error, as its squared distances
    wouldn't fit 64 bits."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kept = table.filter(x.isNotNull() & (F.size(x) == size)).filter(finite)

    def whole(c: Column) -> Column:
        y = c.cast("double") * scale
        return F.when(F.abs(y) < LARGEST, F.floor(y).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int"))

    return kept.select(F.col(id_col), F.transform(x, whole).alias("v"))


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= _SMALL and v.shape[1] <= 1024:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return np.rint((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((v - one) ** 2).sum(1) for one in c], axis=1)


def nearest(
    history: np.ndarray, v: np.ndarray, own: np.ndarray, dist: np.ndarray, seen: np.ndarray, settle: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of the last centroids for each vector: its number, its squared distance where that was worked out (else
    -1), and how many distances were worked out. ``dist`` and ``seen`` are brought up to date in place.

    ``history``: round, centroid, component. ``own``: the last assignment, ``dist`` and ``seen``: distances and the rounds in
    which they held. ``settle`` works every own distance out.
    """
    now, n = len(history) - 1, len(v)
    rows = np.arange(n)
    last = history[now]
    moved = np.sqrt(((last[None] - history) ** 2).sum(2).astype(np.float64))  # since each round
    drift = moved[seen, np.arange(len(last))[None, :]]
    low, upper = dist - drift, dist[rows, own] + drift[rows, own]
    slack = _SLACK * (dist + drift + upper[:, None] + 1)
    open_ = low - slack <= upper[:, None]
    open_[rows, own] = False
    # First the own distance anew, where a bound fails; that alone closes most.
    square = np.full(n, -1, np.int64)
    look = np.flatnonzero(open_.any(1) | settle)
    square[look] = ((v[look] - last[own[look]]) ** 2).sum(1)
    dist[look, own[look]], seen[look, own[look]] = np.sqrt(square[look].astype(np.float64)), now
    upper[look] = dist[look, own[look]]
    open_[look] &= low[look] - slack[look] <= upper[look, None]
    i, j = np.nonzero(open_)
    far = np.empty(len(i), np.int64)
    for a in range(0, len(i), 1 << 16):
        far[a : a + (1 << 16)] = ((v[i[a : a + (1 << 16)]] - last[j[a : a + (1 << 16)]]) ** 2).sum(1)
    dist[i, j], seen[i, j] = np.sqrt(far.astype(np.float64)), now
    best = own.copy()
    # Of the centroids looked at, the nearest; of equally near ones the smaller number.
    order = np.lexsort((j, far, i))
    i, j, far = i[order], j[order], far[order]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    i, j, far = i[first], j[first], far[first]
    better = (far < square[i]) | (far == square[i]) & (j < own[i])
    best[i[better]], square[i[better]] = j[better], far[better]
    looks = open_.sum(1)
    looks[look] += 1
    return best, square, looks


def _rows(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.array(column.flatten(), dtype=kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.reshape(-1), kind))


def _first_pass(centres: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k, size = centres.shape
    for batch in batches:
        square = _squared(_rows(batch.column("v"), size, np.int64), centres)
        own = square.argmin(1).astype(np.int32)  # the first of equal ones
        yield pa.record_batch(
            {
                "id": batch.column("id"),
                "v": batch.column("v"),
                "was": pa.nulls(len(own), pa.int32()),
                "cluster": pa.array(own),
                "dist": _lists(np.sqrt(square.astype(np.float64)), pa.float64()),
                "seen": _lists(np.zeros(square.shape, np.int16), pa.int16()),
                "looks": pa.array(np.full(len(own), k, np.int32)),
            }
        )


def _next_pass(history: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, k, size = history.shape
    for batch in batches:
        own = np.asarray(batch.column("cluster"), np.int64)
        dist, seen = _rows(batch.column("dist"), k, np.float64), _rows(batch.column("seen"), k, np.int16)
        best, _, looks = nearest(history, _rows(batch.column("v"), size, np.int64), own, dist, seen, False)
        yield pa.record_batch(
            {
                "id": batch.column("id"),
                "v": batch.column("v"),
                "was": pa.array(own.astype(np.int32)),
                "cluster": pa.array(best.astype(np.int32)),
                "dist": _lists(dist, pa.float64()),
                "seen": _lists(seen, pa.int16()),
                "looks": pa.array(looks.astype(np.int32)),
            }
        )


def _last_pass(history: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, k, size = history.shape
    for batch in batches:
        own = np.asarray(batch.column("cluster"), np.int64)
        dist, seen = _rows(batch.column("dist"), k, np.float64), _rows(batch.column("seen"), k, np.int16)
        best, square, looks = nearest(history, _rows(batch.column("v"), size, np.int64), own, dist, seen, True)
        yield pa.record_batch(
            {
                "id": batch.column("id"),
                "cluster": pa.array(best.astype(np.int32)),
                "distance": pa.array(square),
                "looks": pa.array(looks.astype(np.int32)),
            }
        )


def _first_centroids(vectors: DataFrame, clusters: int, seed: int, id_col: str) -> list[list[int]]:
    said = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    found = vectors.select(said.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()  # a row per cluster
    return [r.v for r in found]


def centroid_clusters(vectors: DataFrame, clusters: int, rounds: int, seed: int, id_col: str = "vec_id") -> DataFrame:
    """The cluster of every row of :func:`integer_vectors` after ``rounds`` updates of the centroids.

    Centroids begin as the rows with the smallest sha256 of ``<seed>:<id>``, in that order. Every round assigns each
    vector to the nearest (squared Euclidean distance, ties to the smaller number) and moves each centroid that has any to
    the floor of their mean; then all are assigned once more. Returns ``id_col``, ``cluster``, ``distance`` (squared),
    ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all), ``centroid_sha256`` (of the last
    centroid's components, as decimal numbers joined by commas) and ``looks`` (distances that the last pass worked out).

    Repeated rows are vectors of their own; rows without an id count as an empty one at the start; of equal ids the
    lesser vector begins. Fewer rows than ``clusters`` give as many centroids; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    state_schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("v", T.ArrayType(T.IntegerType())),
            T.StructField("was", T.IntegerType()),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("dist", T.ArrayType(T.DoubleType())),
            T.StructField("seen", T.ArrayType(T.ShortType())),
            T.StructField("looks", T.IntegerType()),
        ]
    )
    last_schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("looks", T.IntegerType())]
    )
    result = "cluster int, distance long, looks int, cluster_inertia long, centroid_sha256 string, inertia long"
    start = _first_centroids(vectors, clusters, seed, id_col)
    if not start:
        return spark.createDataFrame([], f"`{id_col}` {id_type.simpleString()}, {result}")
    history = [start]
    size = len(start[0])
    sums, counts = [[0] * size for _ in start], [0] * len(start)
    components = [F.sum(F.col("v")[i].cast("long") * F.col("sign")).alias(f"x{i}") for i in range(size)]
    state = stage(vectors.select(F.col(id_col).alias("id"), "v").mapInArrow(lambda b, c=np.array(start, np.int64): _first_pass(c, b), state_schema), "clusters-0")
    for k in range(rounds):
        # Vectors that came count for, and from where they left against.
        came = F.struct("cluster", F.lit(1).alias("sign"))
        left = F.struct(F.col("was").alias("cluster"), F.lit(-1).alias("sign"))
        moves = F.when(F.col("was").isNull(), F.array(came)).otherwise(F.array(came, left))
        moved = state.filter("was is null or was <> cluster").select("v", F.inline(moves))
        for r in moved.groupBy("cluster").agg(F.sum("sign").alias("n"), *components).collect():  # a row per cluster
            counts[r["cluster"]] += r["n"]
            sums[r["cluster"]] = [a + r[f"x{i}"] for i, a in enumerate(sums[r["cluster"]])]
        history.append([[a // n for a in s] if n else old for s, n, old in zip(sums, counts, history[-1], strict=True)])
        past = np.array(history, np.int64)
        if k + 1 < rounds:
            following = stage(state.mapInArrow(lambda b, p=past: _next_pass(p, b), state_schema), f"clusters-{k + 1}")
            delete(spark, state.staged_at)
            state = following
    past = np.array(history, np.int64)
    found = stage(state.mapInArrow(lambda b: _last_pass(past, b), last_schema), "clusters-last")
    delete(spark, state.staged_at)
    per = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per cluster
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1]]
    about = spark.createDataFrame([(j, s, said[j], sum(per.values())) for j, s in per.items()], "cluster int, cluster_inertia long, centroid_sha256 string, inertia long")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), *(c.split()[0] for c in result.split(", ")))
