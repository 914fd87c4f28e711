"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words (hashed, square roots of their shares), a score of statistics of its structure
(kinds of characters, word and line lengths, repeated words and lines) and metadata (its stated length). The
machine adds a low-rank interaction of every pair of features, which costs linear time:
sum over pairs of <v_i, v_j> x_i x_j = half the sum over factors of (sum v x)^2 - sum (v x)^2.

Training reads a bounded sample (``PER_CLASS`` labelled rows of each class); scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import labelled_sample, sigmoid
from .textnum import PIECE_BYTES, mix, slices, span_hashes, utf8_parts, word_spans

PER_CLASS = 3000
WORD_BITS = 14
FACTORS = 8
_STATS = 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NEWLINE = np.arange(256) == 10


def _repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: numbers of keys and of distinct keys."""
    both = np.unique(mix(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    return np.bincount(owner, minlength=n), np.bincount(owner[both], minlength=n)


def features(raw: np.ndarray, off: np.ndarray, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (a row per text), and the words as (text, bucket, value) triples."""
    n = len(off) - 1
    size = np.diff(off)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * 256 + raw, minlength=n * 256).reshape(n, 256).astype(np.float64)
    share = kinds / np.maximum(size, 1)[:, None]
    starts, ends, of = word_spans(raw, off, ~_SPACE)
    hashes = span_hashes(raw, starts, ends)
    words, distinct = _repeats(hashes, of, n)
    line_starts, line_ends, line_of = word_spans(raw, off, ~_NEWLINE)
    lines, distinct_lines = _repeats(span_hashes(raw, line_starts, line_ends, fold_case=False), line_of, n)
    some = np.maximum(words, 1)
    letters = share[:, 65:91].sum(1) + share[:, 97:123].sum(1) + share[:, 128:].sum(1)
    last = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    symbol = np.isin(last, np.frombuffer(b"!#$%&*+/<=>@\\^_`{|}~", np.uint8))
    ends_odd = np.bincount(of, symbol, n) / some
    upper_start = np.bincount(of, (raw[starts] >= 65) & (raw[starts] <= 90) if len(starts) else None, n) / some
    one = np.bincount(of, (ends - starts) == 1, n) / some
    stats = np.column_stack(
        [
            share[:, 65:91].sum(1),
            share[:, 48:58].sum(1),
            share[:, [33, 35, 36, 37, 38, 42, 64, 94, 126]].sum(1),
            share[:, 33],
            share[:, 124],
            share[:, [44, 46, 59, 58, 63]].sum(1),
            share[:, _SPACE].sum(1),
            letters,
            share[:, 128:].sum(1),
            ends_odd,
            upper_start,
            one,
            np.where(words > 0, (size - kinds[:, _SPACE].sum(1)) / some, 0) / 10,
            np.where(words > 0, distinct / some, 1),
            np.where(lines > 0, distinct_lines / np.maximum(lines, 1), 1),
            np.log1p(words) / 5,
            np.log1p(size / np.maximum(lines, 1)) / 5,
            np.log1p(lines) / 3,
            np.log1p(np.maximum(stated, 0)) / 8,
            (words == 0).astype(float),
        ]
    )
    bucket = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique((of << WORD_BITS) | bucket, return_counts=True)
    text = key >> WORD_BITS
    return stats, text, key & ((1 << WORD_BITS) - 1), np.sqrt(count / np.maximum(words, 1)[text])


def _forward(model: dict, stats: np.ndarray, text: np.ndarray, bucket: np.ndarray, value: np.ndarray):
    n = len(stats)
    x = (stats - model["mean"]) / model["scale"]
    np.clip(x, -4, 4, out=x)
    x *= 0.5
    w, v = model["w"], model["v"]
    low, high = w[:_STATS], w[_STATS:]
    linear = model["w0"] + x @ low + np.bincount(text, high[bucket] * value, n)
    summed = x @ v[:_STATS]
    squared = (x * x) @ (v[:_STATS] ** 2)
    gathered = v[_STATS:][bucket] * value[:, None]
    for f in range(v.shape[1]):
        summed[:, f] += np.bincount(text, gathered[:, f], n)
        squared[:, f] += np.bincount(text, gathered[:, f] ** 2, n)
    return x, summed, linear + 0.5 * (summed**2 - squared).sum(1)


def fit(stats, text, bucket, value, y: np.ndarray, weight: np.ndarray, rounds: int = 15, batch: int = 256) -> dict:
    """Adaptive gradient steps on the weighted log-loss of mini-batches."""
    draw = np.random.default_rng(7)
    size = _STATS + (1 << WORD_BITS)
    model = {
        "mean": stats.mean(0),
        "scale": stats.std(0) + 1e-3,
        "w0": 0.0,
        "w": np.zeros(size),
        "v": draw.normal(0, 0.02, (size, FACTORS)),
    }
    grown_w, grown_v, grown_0 = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    first = np.searchsorted(text, np.arange(len(y) + 1))
    for _ in range(rounds):
        order = draw.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            lens = first[rows + 1] - first[rows]
            pick = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            t, b, val = np.repeat(np.arange(len(rows)), lens), bucket[pick], value[pick]
            x, summed, z = _forward(model, stats[rows], t, b, val)
            error = (sigmoid(z) - y[rows]) * weight[rows] / len(rows)
            grad_w = np.concatenate([x.T @ error, np.bincount(b, error[t] * val, 1 << WORD_BITS)]) + 1e-5 * model["w"]
            grad_v = np.zeros_like(model["v"])
            v = model["v"]
            grad_v[:_STATS] = x.T @ (error[:, None] * summed) - v[:_STATS] * ((x * x).T @ error)[:, None]
            own = np.bincount(b, error[t] * val * val, 1 << WORD_BITS)
            for f in range(FACTORS):
                grad_v[_STATS:, f] = np.bincount(b, error[t] * val * summed[t, f], 1 << WORD_BITS)
            grad_v[_STATS:] -= v[_STATS:] * own[:, None]
            grad_v += 1e-5 * v
            grad_0 = error.sum()
            grown_w += grad_w**2
            grown_v += grad_v**2
            grown_0 += grad_0**2
            model["w"] -= 0.1 * grad_w / np.sqrt(grown_w)
            model["v"] -= 0.02 * grad_v / np.sqrt(grown_v)
            model["w0"] -= 0.1 * grad_0 / np.sqrt(grown_0)
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", per_class: int = PER_CLASS) -> dict:
    """A model from labelled rows. Without rows of both classes the score is constant."""
    docs = docs.select("doc_id", "text", _stated(docs).alias("__stated"))
    rows, counts = labelled_sample(
        docs, labels, label, per_class, usable, extra=["__stated"], describe=_described, described=("stats", "bucket", "value")
    )
    total = sum(counts.get(k, 0) for k in (0, 1))
    prior = counts.get(1, 0) / total if total else 1.0
    rows = [r for r in rows if r.y in (0, 1)]
    y = np.array([r.y for r in rows], float)
    if not len(y) or min(y.sum(), (1 - y).sum()) < 4:
        return {"prior": prior}
    stats = np.stack([np.frombuffer(r.stats, np.float64) for r in rows])
    bucket, value = [np.frombuffer(r.bucket, np.int32) for r in rows], [np.frombuffer(r.value, np.float32) for r in rows]
    text = np.repeat(np.arange(len(rows), dtype=np.int32), [len(b) for b in bucket])
    parts = (stats, text, np.concatenate(bucket), np.concatenate(value))
    # Rows weigh as their class does among all labelled rows.
    share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return {"prior": prior} | fit(*parts, y, share)


def _described(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """``features`` of each text as bytes."""
    stats, text, bucket, value = features(*utf8_parts(batch.column("text")), np.asarray(batch.column("__stated").cast(pa.float64())))
    edges = np.searchsorted(text, np.arange(batch.num_rows + 1))
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
    return {
        "stats": pa.array([x.tobytes() for x in stats.astype(np.float64)], pa.binary()),
        "bucket": cut(bucket.astype(np.int32)),
        "value": cut(value.astype(np.float32)),
    }



def _stated(docs: DataFrame) -> Column:
    """The stated length of a text, or its length where none is stated."""
    length = F.char_length(F.coalesce(F.col("text"), F.lit("")))
    return (F.coalesce(F.col("n_chars"), length) if "n_chars" in docs.columns else length).cast("double")


def score(docs: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1, higher: likelier good) for every row; whole texts.

    Null text counts as empty and is scored like any other; null and repeated ids are carried through; an
    empty table gives an empty result. Of further columns only ``n_chars`` is read, if it is there.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            if "w" in model:
                raw, off = utf8_parts(batch.column("text"))
                parts = features(raw, off, np.asarray(batch.column("stated")))
                p = sigmoid(_forward(model, *parts)[2])
            else:
                p = np.full(batch.num_rows, model["prior"])
            yield pa.record_batch({"id": batch.column("id"), "score": pa.array(np.round(p, 6))})

    schema = T.StructType([T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    rows = docs.select(F.col(id_col).alias("id"), F.col("text").alias("text"), _stated(docs).alias("stated"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score below ``least``, all columns kept (stage of the pipeline).

    Each row is judged by itself in one pass, so repeated and null ids need no join.
    """
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE_BYTES):
            if "w" in model:
                raw, off = utf8_parts(batch.column("text"))
                p = sigmoid(_forward(model, *features(raw, off, np.asarray(batch.column("__stated"))))[2])
            else:
                p = np.full(batch.num_rows, model["prior"])
            yield batch.select(columns).filter(pa.array(np.round(p, 6) >= least))

    return docs.withColumn("__stated", _stated(docs)).mapInArrow(run, docs.schema)
