"""kNN over quantised vectors: a first pass over packed codes with bounds, exact cosines for what can still win.

A component lies within half a step of its code's value, so a dot product with a query is off by half a step times the sum of the
query's magnitudes at most. A row whose upper bound is below the ``k``-th best lower bound of its query can't be among the best;
for all others the whole vectors are joined and compared. The result equals the exact join; the first pass moves codes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from .vectors import BLOCK, STEP, best_of, cosine, dealing, matrix, measure, sides

#: Rounding of cosines to 6 digits, and of bounds in floating point.
_MARGIN = 2e-6


def quantised_table(right: DataFrame, right_id: str, right_skip: str | None = None, vector: str = "embedding", bits: int = 4) -> DataFrame:
    """``r_id``, ``codes`` (packed, ``bits`` of 2, 4 or 8 a component), ``low``, ``step``, ``length`` and maybe ``r_skip``. Null vectors
    have no row."""
    if bits not in (2, 4, 8):
        raise ValueError("2, 4 or 8 bits a component")
    rows = sides(right, "r", right_id, right_skip, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("r_vec").flatten(), np.float64).reshape(batch.num_rows, -1)
            low, high = x.min(1), x.max(1)
            step = np.where(high > low, (high - low) / ((1 << bits) - 1), 1.0)
            code = np.rint((x - low[:, None]) / step[:, None]).astype(np.uint8)
            code = np.pad(code, ((0, 0), (0, -code.shape[1] % (8 // bits))))
            packed = sum(code[:, j :: 8 // bits] << (bits * j) for j in range(8 // bits)).astype(np.uint8)
            out = {"r_id": batch.column("r_id"), "codes": pa.array([c.tobytes() for c in packed], pa.binary())}
            out |= {"low": pa.array(low), "step": pa.array(step), "length": pa.array(np.linalg.norm(x, axis=1))}
            yield pa.record_batch(out | ({"r_skip": batch.column("r_skip")} if right_skip else {}))

    fields = [rows.schema["r_id"], T.StructField("codes", T.BinaryType()), *(T.StructField(c, T.DoubleType()) for c in ("low", "step", "length"))]
    return rows.mapInArrow(run, T.StructType([*fields, *([rows.schema["r_skip"]] if right_skip else [])]))


def _candidates(k: int, bits: int, dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a left block and a stream of codes that may be among the ``k`` best, with both bounds."""
    left: list[pa.RecordBatch] = []
    unit, best, found = None, None, []
    for batch in batches:
        at = int(np.searchsorted(np.asarray(batch.column("side")), 1))
        if at:
            left.append(batch.slice(0, at))
        for start in range(at, batch.num_rows, STEP):
            if not left:
                return
            if unit is None:
                rows = pa.Table.from_batches(left)
                unit, skips = matrix(rows["vec"]), rows["skip"].to_numpy() if "skip" in rows.column_names else None
                size, best = np.abs(unit).sum(1), np.full((len(unit), k), -np.inf)
            some = batch.slice(start, STEP)
            packed = np.frombuffer(b"".join(some.column("codes").to_pylist()), np.uint8).reshape(some.num_rows, -1)
            code = np.stack([(packed >> (bits * j)) & ((1 << bits) - 1) for j in range(8 // bits)], 2).reshape(some.num_rows, -1)[:, :dim]
            low, step, length = (np.asarray(some.column(c)) for c in ("low", "step", "length"))
            inverse = np.divide(1.0, length, out=np.zeros(len(length)), where=length > 0)
            near = unit @ ((low[:, None] + step[:, None] * code) * inverse[:, None]).T
            off = size[:, None] * (step / 2 * inverse)[None, :] * (1 + 1e-9)
            lower, upper = near - off, near + off
            if skips is not None:
                own = skips[:, None] == some.column("skip").to_numpy(zero_copy_only=False)[None, :]
                lower[own], upper[own] = -np.inf, -np.inf
            best = np.partition(np.concatenate([best, lower], 1), best.shape[1] + lower.shape[1] - k, axis=1)[:, -k:]
            i, j = np.nonzero((upper >= best.min(1)[:, None] - _MARGIN) & np.isfinite(upper))
            found.append((i, upper[i, j], lower[i, j], some.column("r_id").take(pa.array(j))))
    if found:
        i, upper, lower = (np.concatenate([x[c] for x in found]) for c in range(3))
        kept = np.flatnonzero(upper >= best.min(1)[i] - _MARGIN)
        ids = pa.concat_arrays([x[3] for x in found]).take(pa.array(kept))
        owner = rows["l_id"].combine_chunks().take(pa.array(i[kept]))
        yield pa.record_batch({"l_id": owner, "r_id": ids, "upper": pa.array(upper[kept]), "lower": pa.array(lower[kept])})


def quantised_candidates(
    left: DataFrame, codes: DataFrame, k: int, left_id: str, left_skip: str | None = None, vector: str = "embedding", bits: int = 4, block: int = BLOCK
) -> DataFrame:
    """``l_id``, ``r_id`` of all pairs that may be among a left row's ``k`` best, from codes alone."""
    n, dim = measure(left, vector)
    n_right = codes.count()
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, shares = dealing(n, n_right, tasks, block)
    upto = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    a, b = sides(left, "l", left_id, left_skip, vector), codes
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    numbers = ("low", "step", "length")
    skip = lambda p: [F.col(f"{p}_skip").alias("skip")] if left_skip else []
    rows = a.select(
        F.pmod(F.xxhash64("l_id"), F.lit(blocks)).cast("int").alias("block"), upto(shares).alias("share"), F.lit(0).alias("side"), "l_id",
        none("r_id", b.schema["r_id"].dataType), F.col("l_vec").alias("vec"), none("codes", "binary"), *(none(c, "double") for c in numbers), *skip("l"),
    ).unionByName(
        b.select(
            upto(blocks).alias("block"), F.pmod(F.xxhash64("r_id"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("side"),
            none("l_id", a.schema["l_id"].dataType), "r_id", none("vec", a.schema["l_vec"].dataType), "codes", *numbers, *skip("r"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _candidates(k, bits, dim, batches)

    schema = f"l_id {a.schema['l_id'].dataType.simpleString()}, r_id {b.schema['r_id'].dataType.simpleString()}, upper double, lower double"
    dealt = rows.repartition("block", "share").sortWithinPartitions("block", "share", "side")
    found = cut(dealt.groupBy("block", "share").applyInArrow(run, schema))
    # The k-th best lower bound over all shares.
    floor = best_of(found.withColumnRenamed("lower", "cos").drop("upper"), k).groupBy("l_id").agg(F.min("cos").alias("least"), F.count(F.lit(1)).alias("n"))
    kept = found.join(floor, "l_id").filter((F.col("n") < k) | (F.col("upper") >= F.col("least") - _MARGIN))
    return kept.select("l_id", "r_id")


def quantised_join(
    left: DataFrame,
    right: DataFrame,
    k: int,
    left_id: str,
    right_id: str,
    left_skip: str | None = None,
    right_skip: str | None = None,
    vector: str = "embedding",
    bits: int = 4,
    codes: DataFrame | None = None,
) -> DataFrame:
    """The rows of :func:`.vectors.knn_join`, by way of ``codes`` (:func:`quantised_table` of ``right``, made here by default)."""
    (n, dim), (m, other) = measure(left, vector), measure(right, vector)
    if n and m and dim != other:
        raise ValueError(f"the left vectors have {dim} dimensions, the right ones {other}")
    if codes is None:
        codes = quantised_table(right, right_id, right_skip, vector, bits)
    pairs = quantised_candidates(left, codes, max(1, k), left_id, left_skip, vector, bits)
    whole = pairs.join(sides(left, "l", left_id, None, vector), "l_id").join(sides(right, "r", right_id, None, vector), "r_id")
    scored = whole.select("l_id", "r_id", F.round(cosine(F.col("l_vec"), F.col("r_vec")), 6).alias("cos"))
    return best_of(scored, k).select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id), "cos", "rank")
