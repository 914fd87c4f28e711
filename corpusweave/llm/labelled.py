"""Bounded training samples of labelled documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textnum import slices


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    extra: list[str] | None = None,
    describe: Callable[[pa.RecordBatch], dict[str, pa.Array]] | None = None,
    described: tuple[str, ...] = (),
) -> tuple[list, dict]:
    """At most ``per_class`` labelled rows of each class, and the number of labelled rows of each class.

    Rows are taken in the order of a hash of their id, so the sample is the same in every run. Only as small a
    share of a class as surely holds enough rows (ten standard deviations more than ``per_class``) is sorted, so
    no task gets a whole class. Rows with a null label, or which ``usable`` (over ``labels``) excludes, are out. The classes must be few: the bound
    holds for each of them. Of equal texts, the row with the least id counts.

    ``describe`` turns batches with ``text`` and ``extra`` into the binary columns ``described`` in the tasks, from whole
    texts; then these are collected in place of the texts.
    """
    from pyspark.sql import Window

    rows = labels.filter(usable & F.col(label).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label).alias("y"))
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    # Hashes are even over the range of a long, so the lowest ones of a class are a share of its rows.
    low = F.lit(False)
    for y, n in counts.items():
        share = min(1.0, (per_class + 10 * per_class**0.5 + 10) / n)
        low = low | ((F.col("y") == F.lit(y)) & (F.col("__h") <= int((share - 0.5) * 2**64) - (share == 1.0)))
    order = Window.partitionBy("y").orderBy("__h", "__id")
    hashed = rows.withColumn("__h", F.xxhash64("__id")).filter(low)
    chosen = hashed.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= per_class).drop("__h")
    # As many rows as the bound allows, so they may be broadcast.
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.join(F.broadcast(chosen), docs[id_col] == F.col("__id")).select(
        F.col("__id").alias("id"), "y", F.xxhash64(text).alias("key"), text.alias("text"), *(extra or [])
    )
    if describe:
        head = ["id", "y", "key"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", limit=500_000, rows=500):
                yield pa.record_batch({c: batch.column(c) for c in head} | describe(batch))

        fields = [texts.schema[c] for c in head] + [T.StructField(c, T.BinaryType()) for c in described]
        texts = texts.mapInArrow(run, T.StructType(fields))
    found = sorted(texts.collect(), key=lambda r: (str(r.id), r.key))
    seen: set[int] = set()
    distinct = [r for r in found if not (r.key in seen or seen.add(r.key))]
    return distinct, counts


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        slope = x.T @ (weight * (y - p)) - penalty * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta
