"""An inverted file over vectors: cells around coarse centroids, and the kNN join that looks into a few of them.

Building: centroids are fitted on a bounded sample of rows, then every row goes to the cell of its nearest centroid. A cell
knows how many rows it has and how far (by angle) its farthest lies from the centroid. Cells with more rows than a block are
dealt out over several blocks, so cells of alike rows don't grow into one task.

Searching: a query looks into its ``probes`` nearest cells. Then a second look goes through the other cells wherever it is
needed: for queries that have found fewer than ``k`` rows, and, with ``certain``, through all cells that may hold a row at
least as near as the ``k``-th found. By the triangle inequality no row of a cell is nearer to a query than their angle to the
centroid less the cell's radius, so a certain search equals the exact join.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut, shared_folder
from .vectors import BLOCK, best_of, block_top, found_schema, knn_join, matrix, measure, normalised, sides

#: Rows that centroids are fitted on, and bytes of centroids, which every task gets; more cells than that aren't made.
SAMPLE_ROWS, CENTROID_BYTES = 100_000, 32 << 20
_PARTS = 1 << 20


@dataclass(frozen=True)
class CellIndex:
    """``rows``: ``cell``, ``block``, ``r_id``, ``r_vec`` and maybe ``r_skip``. The arrays have an entry per cell."""

    centroids: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    rows: DataFrame
    block: int

    def blocks(self) -> np.ndarray:
        return np.maximum(1, -(-self.sizes // self.block))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _table(spark: SparkSession, values: np.ndarray, name: str) -> DataFrame:
    """A row per cell."""
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(values)], f"cell int, {name} int")


def _fitted(rows: DataFrame, n: int, cells: int, sample: int, seed: int) -> np.ndarray:
    share = math.ceil(_PARTS * min(1.0, sample / max(1, n)))
    some = rows.filter(F.pmod(F.xxhash64("r_id", F.lit(seed)), F.lit(_PARTS)) < share).select(normalised(F.col("r_vec")).alias("v"))
    some = cut(some.filter(F.exists("v", lambda x: x != 0)).select(array_to_vector("v").alias("features")))
    if not some.take(1):
        return np.zeros((1, len(rows.first()["r_vec"])))
    found = np.array(KMeans(k=cells, seed=seed, maxIter=8, initSteps=2).fit(some).clusterCenters()) if cells > 1 else np.array([some.first()[0].toArray()])
    length = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(length == 0, 1, length)


def build_index(
    right: DataFrame,
    right_id: str,
    right_skip: str | None = None,
    vector: str = "embedding",
    cells: int | None = None,
    sample: int = SAMPLE_ROWS,
    seed: int = 1,
    block: int = BLOCK,
    path: str | None = None,
) -> CellIndex:
    """An index of every row with a vector, written to ``path`` (by default in the cluster's shared folder), a folder per cell.

    ``cells``: by default the square root of the rows. Centroids are fitted on about ``sample`` rows, dealt by a hash of the
    id; everything else sees all rows. Vectors as :func:`.vectors.measure` demands them.
    """
    spark = right.sparkSession
    n, dim = measure(right, vector)
    rows = sides(right, "r", right_id, right_skip, vector)
    path = path or f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    if not n:
        return CellIndex(np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64), rows.withColumns({"cell": F.lit(0), "block": F.lit(0)}).limit(0), block)
    cells = min(cells or max(1, round(math.sqrt(n))), max(1, CENTROID_BYTES // (8 * dim)), n)
    centroids = _fitted(rows, n, cells, sample, seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = matrix(pa.chunked_array([batch.column("r_vec")]))
                cosines = unit @ centroids.T
                cell = cosines.argmax(1)
                away = _angles(cosines[np.arange(len(cell)), cell])
                away[~unit.any(1)] = math.pi  # a zero vector has no direction: its cell is always looked into
                yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("away", pa.array(away))

    placed = cut(rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])))
    sizes, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect():  # a row per cell
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["away"]
    split = _table(spark, np.maximum(1, -(-sizes // block)), "blocks")
    dealt = placed.drop("away").join(F.broadcast(split), "cell").withColumn("block", F.pmod(F.xxhash64("r_id"), F.col("blocks")).cast("int")).drop("blocks")
    dealt.repartition("cell", "block").write.partitionBy("cell").parquet(f"{path}/rows")
    about = [(i, c.tolist(), float(radius[i]), int(sizes[i])) for i, c in enumerate(centroids)]
    spark.createDataFrame(about, "cell int, centroid array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/cells")
    return load_index(spark, path, block)


def load_index(spark: SparkSession, path: str, block: int = BLOCK) -> CellIndex:
    """The index of a folder that :func:`build_index` wrote with the same ``block``."""
    about = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # a row per cell, CENTROID_BYTES in all
    centroids, radius, sizes = (np.array([r[c] for r in about]) for c in ("centroid", "radius", "n"))
    return CellIndex(centroids, radius, sizes, spark.read.parquet(f"{path}/rows"), block)


def _look(asked: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """The ``k`` best rows for every pair of a query and a cell, block by block."""
    spark = asked.sparkSession
    per_cell = np.zeros(len(index.sizes), np.int64)
    for r in asked.groupBy("cell").count().collect():  # a row per cell
        per_cell[r["cell"]] = r["count"]
    # Queries of a cell are dealt out over blocks as its rows are.
    halves = _table(spark, np.maximum(1, -(-per_cell // index.block)), "l_blocks").join(_table(spark, index.blocks(), "r_blocks"), "cell")
    halves = F.broadcast(halves)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = asked.join(halves, "cell").withColumn("l_block", F.pmod(F.xxhash64("l_id"), F.col("l_blocks")).cast("int"))
    a = a.withColumn("block", upto("r_blocks")).drop("l_blocks", "r_blocks")
    b = index.rows.join(halves, "cell").withColumn("l_block", upto("l_blocks")).drop("l_blocks", "r_blocks")
    keys = ["cell", "block", "l_block"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(lambda x, y: block_top(k, x, y), found_schema(a, b))


def cell_join(
    left: DataFrame,
    index: CellIndex,
    k: int,
    left_id: str,
    right_id: str,
    left_skip: str | None = None,
    vector: str = "embedding",
    probes: int | None = None,
    certain: bool = False,
    recall: float = 0.95,
    allow: DataFrame | None = None,
) -> DataFrame:
    """:func:`.vectors.knn_join` through an index; ids of ``left`` are distinct. ``probes``: cells that each query looks into first,
    by default as many as a sample of the queries needs for ``recall`` (:func:`choose_probes`), or a tenth of all with
    ``certain``, which gives exactly the nearest rows."""
    spark = left.sparkSession
    n, dim = measure(left, vector)
    cells = len(index.sizes)
    if n and cells and dim != index.centroids.shape[1]:
        raise ValueError(f"the left vectors have {dim} dimensions, the index {index.centroids.shape[1]}")
    if allow is not None:
        allowed = allow.select(F.col(right_id).alias("r_id")).distinct()
        index = CellIndex(index.centroids, index.radius, index.sizes, index.rows.join(allowed, "r_id", "left_semi"), index.block)
    asking = sides(left, "l", left_id, left_skip, vector)
    rows = index.rows
    if not n or not cells or k < 1:
        none = spark.createDataFrame([], found_schema(asking, rows) + ", rank int")
        return none.select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id), "cos", "rank")
    if probes is None:
        probes = math.ceil(cells / 10) if certain else choose_probes(left, index, k, left_id, left_skip, vector, recall)
    probes = min(cells, probes)
    centroids, radius, filled = index.centroids, index.radius, index.sizes > 0

    def near(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        cosines = matrix(pa.chunked_array([batch.column("l_vec")])) @ centroids.T
        first = np.zeros(cosines.shape, bool)
        np.put_along_axis(first, np.argsort(-np.where(filled, cosines, -2), axis=1, kind="stable")[:, :probes], True, 1)
        return cosines, first & filled

    def pairs(batch: pa.RecordBatch, looked: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(looked)
        for at in range(0, len(i), 20_000):
            some = batch.take(pa.array(i[at : at + 20_000]))
            yield some.append_column("cell", pa.array(j[at : at + 20_000].astype(np.int32)))

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from pairs(batch, near(batch)[1])

    def second_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosines, looked = near(batch)
            worst = batch.column("worst").to_numpy(zero_copy_only=False).astype(np.float64)  # NaN: fewer than k found
            short = np.isnan(worst)
            can = np.zeros(cosines.shape, bool)
            if certain:
                best = np.cos(np.maximum(0, _angles(cosines) - radius))
                can = best >= np.where(short, -2, worst)[:, None] - 2e-6  # cosines are rounded to 6 digits
            yield from pairs(batch.drop_columns(["worst"]), (can | short[:, None]) & ~looked & filled)

    with_cell = T.StructType([*asking.schema.fields, T.StructField("cell", T.IntegerType())])
    found = cut(best_of(_look(asking.mapInArrow(first_look, with_cell), index, k), k).drop("rank"))
    have = found.groupBy("l_id").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("worst"))
    worst = have.filter(F.col("n") == k).select("l_id", "worst")
    again = asking.join(worst, "l_id", "left")
    if not certain:
        again = again.filter("worst is null")
    more = _look(cut(again.mapInArrow(second_look, with_cell)), index, k)
    out = best_of(found.unionByName(more), k)
    return out.select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id), "cos", "rank")


def choose_probes(
    left: DataFrame, index: CellIndex, k: int, left_id: str, left_skip: str | None = None, vector: str = "embedding", recall: float = 0.95, sample: int = 200
) -> int:
    """The fewest probes by which about ``sample`` of the queries (dealt by a hash of their ids) find ``recall`` of their true ``k``
    neighbours, as the exact join tells them: where in a query's order of cells the cell of each true neighbour stands."""
    share = math.ceil(_PARTS * min(1.0, sample / max(1, measure(left, vector)[0])))
    asking = sides(left, "l", left_id, left_skip, vector).filter(F.pmod(F.xxhash64("l_id", F.lit(7)), F.lit(_PARTS)) < share)
    rows = index.rows.withColumn("vector", F.col("r_vec"))
    skip = ("l_skip", "r_skip") if left_skip and "r_skip" in rows.columns else (None, None)
    true = knn_join(asking.withColumn("vector", F.col("l_vec")), rows, k, "l_id", "r_id", *skip, vector="vector")
    cells = true.join(rows.select("r_id", "cell"), "r_id").groupBy("l_id").agg(F.collect_list("cell").alias("cells"))
    centroids, filled = index.centroids, index.sizes > 0

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-np.where(filled, matrix(pa.chunked_array([batch.column("l_vec")])) @ centroids.T, -2), axis=1, kind="stable")
                place = np.argsort(order, axis=1)
                found = [place[i, np.array(c, np.int64)] for i, c in enumerate(batch.column("cells").to_pylist())]
                yield pa.record_batch({"place": pa.array(np.concatenate(found).astype(np.int32))})

    counts = asking.join(cells, "l_id").mapInArrow(places, "place int").groupBy("place").count().orderBy("place").collect()  # a row per cell
    total, reached = sum(r["count"] for r in counts), 0
    for r in counts:
        reached += r["count"]
        if reached >= recall * total:
            return r["place"] + 1
    return max(1, len(index.sizes))
