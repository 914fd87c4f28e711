"""Language identification in two steps: the family first, then the language within it.

Texts become histograms of hashed byte bigrams and trigrams (lower-cased; digits and marks as one sign), square
roots of shares. One-versus-one linear support vector machines decide between the families, and within the
chosen family between its languages. Languages that no family of the table names form one each.

Training reads a bounded sample (``PER_CLASS`` rows of each language); prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import labelled_sample, sigmoid
from .textnum import slices, utf8_parts

PER_CLASS = 1500
BUCKETS = 1 << 13

# ISO 639-1 codes of the languages of some families.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la lmo oc pt rm ro sc scn",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az ba crh kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "ckb fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "malayo-polynesian": "ceb id jv mg ms su tl",
}

_FOLD = np.full(256, 1, np.int64)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[[9, 10, 11, 12, 13, 32]] = 32


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), f"only {code}")


def histograms(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row per text: square roots of the shares of hashed bigrams and trigrams."""
    n = len(off) - 1
    if not len(raw):
        return np.zeros((n, BUCKETS), np.float32)
    b = _FOLD[raw]
    owner = np.repeat(np.arange(n), np.diff(off))
    out = np.zeros(n * BUCKETS)
    for width in (2, 3):
        if len(b) < width:
            continue
        code = np.zeros(len(b) - width + 1, np.int64)
        for k in range(width):
            code = code * 331 + b[k : len(b) - width + 1 + k]
        same = owner[: len(code)] == owner[width - 1 :]
        slot = ((code * 0x9E3779B1) >> 7) % BUCKETS
        out += np.bincount((owner[: len(code)] * BUCKETS + slot)[same], minlength=n * BUCKETS)
    out = out.reshape(n, BUCKETS)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1)).astype(np.float32)


def _svm(x: np.ndarray, own: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 1500) -> tuple[np.ndarray, float]:
    """A linear support vector machine over the rows ``own`` of ``x`` (labels ``y``, -1 and 1): averaged stochastic
    subgradients of the hinge loss."""
    draw = np.random.default_rng(11)
    sides = [np.flatnonzero(y < 0), np.flatnonzero(y > 0)]
    w, b, mean_w, mean_b, kept = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0
    for t in range(1, steps + 1):
        rows = np.concatenate([draw.choice(s, 32) for s in sides])
        rate = 1.0 / (ridge * (t + 1000))
        taken = x[own[rows]].astype(np.float32)
        miss = y[rows] * (taken @ w.astype(np.float32) + b) < 1
        w *= 1 - rate * ridge
        if miss.any():
            w += rate / 64 * (y[rows[miss]] @ taken[miss])
            b += rate / 64 * y[rows[miss]].sum() * 0.1
        if t > steps // 2:
            mean_w += w
            mean_b += b
            kept += 1
    return mean_w / kept, mean_b / kept


def _pairs(x: np.ndarray, own: np.ndarray, y: list[str]) -> dict:
    """Machines of all pairs of names; ``y`` names the rows ``own`` of ``x``."""
    names, y = sorted(set(y)), np.array(y)
    out = {}
    for a, b in combinations(names, 2):
        rows = np.flatnonzero((y == a) | (y == b))
        sign = np.where(y[rows] == b, 1.0, -1.0)
        out[a, b] = _svm(x, own[rows], sign)
    return {"names": names, "machines": out}


def _described(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """Histograms as bytes: the filled buckets of each, and their values."""
    out = {"slot": [], "share": []}
    for x in histograms(*utf8_parts(batch.column("text"))):
        filled = np.flatnonzero(x)
        out["slot"].append(filled.astype(np.uint16).tobytes())
        out["share"].append(x[filled].astype(np.float16).tobytes())
    return {c: pa.array(v, pa.binary()) for c, v in out.items()}


def train(docs: DataFrame, usable: Column, lang_col: str = "lang", per_class: int = PER_CLASS) -> dict:
    """Machines from the rows of ``docs`` which ``usable`` admits and whose language is given."""
    spoken = docs.filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "text")
    rows, _ = labelled_sample(
        spoken, docs.select("doc_id", lang_col), lang_col, per_class, usable, describe=_described, described=("slot", "share")
    )
    if not rows:
        return {}
    # Half precision and rows taken by number: the driver holds one copy of the sample, 16 kB a row.
    x = np.zeros((len(rows), BUCKETS), np.float16)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r.slot, np.uint16)] = np.frombuffer(r.share, np.float16)
    langs = [r.y for r in rows]
    families = [family_of(v) for v in langs]
    model = {"family": _pairs(x, np.arange(len(rows)), families), "within": {}}
    for f in sorted(set(families)):
        own = np.array([k for k, v in enumerate(families) if v == f])
        model["within"][f] = _pairs(x, own, [langs[k] for k in own])
    return model


def _decide(x: np.ndarray, pairs: dict) -> tuple[np.ndarray, np.ndarray]:
    """The name with most votes (ties: larger sum of margins, then the first name) and its probability: the
    smallest of its pairs."""
    names = pairs["names"]
    votes, margins = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    least = np.ones((len(x), len(names)))
    at = {n: k for k, n in enumerate(names)}
    for (a, b), (w, bias) in pairs["machines"].items():
        z = x @ w + bias
        votes[:, at[b]] += z > 0
        votes[:, at[a]] += z <= 0
        margins[:, at[b]] += np.tanh(z)
        margins[:, at[a]] -= np.tanh(z)
        p = sigmoid(3 * z)
        least[:, at[b]] = np.minimum(least[:, at[b]], p)
        least[:, at[a]] = np.minimum(least[:, at[a]], 1 - p)
    best = np.argmax(votes + 1e-3 * margins, axis=1)
    return best, least[np.arange(len(x)), best]


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` (0 to 1) for every row; whole texts.

    ``und`` with score 0 where the text is null or has no letter, or nothing could be learned. Null and repeated
    ids are carried through; an empty table gives an empty result; further columns are ignored.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", limit=1_000_000, rows=500):
            found = np.full(batch.num_rows, "und", object)
            p = np.zeros(batch.num_rows)
            some = np.flatnonzero(np.asarray(batch.column("letter").fill_null(False)))
            if len(some) and model:
                x = histograms(*utf8_parts(batch.column("text").take(pa.array(some))))
                family, sure = _decide(x, model["family"])
                for k, name in enumerate(model["family"]["names"]):
                    own = np.flatnonzero(family == k)
                    if len(own):
                        inner = model["within"][name]
                        best, inside = _decide(x[own], inner)
                        found[some[own]] = np.array(inner["names"], object)[best]
                        p[some[own]] = sure[own] * inside
            yield pa.record_batch(
                {"id": batch.column("id"), "lang_pred": pa.array(found.tolist(), pa.string()), "score": pa.array(np.round(p, 6))}
            )

    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(text_col).rlike(r"\p{L}").alias("letter"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
