"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary windows of clean texts, one on the toxic passages of
toxic texts. Toxic texts are mostly ordinary, so their passages are found first: short byte n-grams that occur
in many toxic texts and in hardly any clean one mark words, and those words are the samples. Each text is then
cut into windows of about ``WINDOW`` bytes at word starts, every window is compressed with the ordinary
dictionary and with the toxic one (which has the ordinary content too, so that only toxic passages differ), and
the savings of all windows become a few figures per text. A logistic calibration on labelled texts which the
dictionaries haven't seen turns these into a probability, so thresholds on the score mean what they say.

Training reads a bounded sample (``PER_CLASS`` labelled rows of each class); scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import fit_logistic, labelled_sample, sigmoid
from .textnum import slices, utf8_parts, word_spans

#: Labelled rows of each class that training reads at most.
PER_CLASS = 3000
WINDOW = 64
LEVEL = 6
ORDINARY_BYTES, TOXIC_BYTES = 8192, 1024
#: A byte n-gram marks toxic words if it occurs in so many toxic texts (and one in a hundred) and its log-odds are above this.
MARK_TEXTS, MARK_ODDS = 3, 2.5
#: Windows of all sampled clean texts, evenly taken, that the ordinary dictionary is trained on at most.
ORDINARY_WINDOWS = 40_000

# Letters (lower-cased) and bytes of other scripts stand for themselves, all else for a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _windows(raw: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Windows of all texts and the bounds of each text's windows. A window starts with the first word in each
    stretch of WINDOW bytes and ends before the next window; the space before its first word belongs to it."""
    folded = _FOLD[raw]
    starts, _, text = word_spans(folded, off, _FOLD != 32)
    cell = (starts - off[text]) // WINDOW
    first = np.ones(len(starts), bool)
    first[1:] = (text[1:] != text[:-1]) | (cell[1:] != cell[:-1])
    begin, of = starts[first], text[first]
    end = np.append(begin[1:], len(raw))
    end = np.minimum(end, off[of + 1])
    data = folded.tobytes()
    # Longer windows only arise from words longer than WINDOW; these are cut.
    out, owner = [], []
    for a, b, t in zip(begin.tolist(), end.tolist(), of.tolist(), strict=True):
        for at in range(a, b, 16 * WINDOW):
            out.append(b" " + data[at : min(b, at + 16 * WINDOW)])
            owner.append(t)
    return out, np.searchsorted(np.asarray(owner, np.int64), np.arange(len(off)))


def _compressors(ordinary: bytes, toxic: bytes) -> list:
    out = []
    for content in (ordinary, toxic + ordinary):
        params = zstd.ZstdCompressionParameters.from_level(
            LEVEL, source_size=WINDOW, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False
        )
        shared = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=params)
        out.append(zstd.ZstdCompressor(compression_params=params, dict_data=shared))
    return out


def _figures(raw: np.ndarray, off: np.ndarray, ordinary, toxic) -> np.ndarray:
    """Per text: mean and largest saving of a window, shares and numbers of windows that save much, length."""
    windows, bounds = _windows(raw, off)
    a, b = ordinary.compress, toxic.compress
    saved = np.fromiter((len(a(w)) - len(b(w)) for w in windows), np.float64, len(windows))
    n = np.diff(bounds)
    out = np.zeros((len(n), 7))
    some = np.flatnonzero(n)
    if len(some):
        at = bounds[:-1][some]
        size = n[some]
        out[some, 0] = np.add.reduceat(saved, at) / size
        out[some, 1] = np.clip(np.maximum.reduceat(saved, at), 0, 10) / 5
        for k, least in enumerate((3, 5)):
            high = np.add.reduceat((saved >= least).astype(np.float64), at)
            out[some, 2 + 2 * k] = high / size
            out[some, 3 + 2 * k] = np.log1p(high)
        out[some, 6] = np.log1p(size) / 4
    return out


def _grams(words: set[bytes]) -> set[bytes]:
    out: set[bytes] = set()
    for w in words:
        x = b" " + w + b" "
        for n in (5, 6):
            out.update(x[k : k + n] for k in range(len(x) - n + 1))
    return out


def _words(text: str) -> list[bytes]:
    return _FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes().split()


def _parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return utf8_parts(pa.array(texts, pa.large_string()))


def train_dictionaries(toxic: list[str], clean: list[str]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary."""
    in_toxic, in_clean = Counter(), Counter()
    for texts, counter in ((toxic, in_toxic), (clean, in_clean)):
        for t in texts:
            counter.update(_grams(set(_words(t))))
    least = max(MARK_TEXTS, len(toxic) // 100)
    marks = {
        g
        for g, n in in_toxic.items()
        if n >= least and math.log((n + 0.5) / len(toxic) * len(clean) / (in_clean[g] + 0.5)) > MARK_ODDS
    }
    passages = [b" " + b" ".join(w for w in _words(t) if _grams({w}) & marks) + b" " for t in toxic]
    passages = [p for p in passages if len(p) > 8]
    windows: list[bytes] = []
    for at in range(0, len(clean), 200):
        windows += _windows(*_parts(clean[at : at + 200]))[0]
    # The trainer takes windows from all texts alike: every so many-th.
    return _trained(windows[:: 1 + len(windows) // ORDINARY_WINDOWS], ORDINARY_BYTES, 32), _trained(passages, TOXIC_BYTES, 24)


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """zstandard's dictionary trainer; where there are too few samples for it, the samples themselves."""
    try:
        return zstd.train_dictionary(size, samples * (1 + 3000 // max(1, len(samples))), k=segment, d=6).as_bytes()[-size * 7 // 8 :]
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", per_class: int = PER_CLASS) -> dict:
    """Dictionaries and calibration from labelled rows. Without rows of both classes the score is constant."""
    rows, counts = labelled_sample(docs, labels, label, per_class, usable)
    total = sum(counts.get(k, 0) for k in (0, 1))
    prior = counts.get(1, 0) / total if total else 0.0
    sides = {k: [r.text for r in rows if r.y == k] for k in (0, 1)}
    if min(len(x) for x in sides.values()) < 4:
        return {"prior": prior}
    # Rows come in the order of their ids; every third one is for the calibration.
    ordinary, toxic = train_dictionaries(*([x for i, x in enumerate(sides[k]) if i % 3] for k in (1, 0)))
    tools = _compressors(ordinary, toxic)
    held = [(t, k) for k in (0, 1) for t in sides[k][::3]]
    x = np.concatenate([_figures(*_parts([t for t, _ in held[at : at + 200]]), *tools) for at in range(0, len(held), 200)])
    y = np.array([k for _, k in held], float)
    share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return {"prior": prior, "ordinary": ordinary, "toxic": toxic, "beta": fit_logistic(x, y, share, 0.02)}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1, higher: likelier toxic) for every row; whole texts.

    Null and empty texts, and texts without letters, have no windows and get the calibration's value for that.
    Null and repeated ids are carried through; an empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _compressors(model["ordinary"], model["toxic"]) if "beta" in model else None
        for batch in slices(batches, "text"):
            if tools:
                x = _figures(*utf8_parts(batch.column("text")), *tools)
                p = sigmoid(np.column_stack([x, np.ones(len(x))]) @ model["beta"])
            else:
                p = np.full(batch.num_rows, model["prior"])
            yield pa.record_batch({"id": batch.column("id"), "score": pa.array(np.round(p, 6))})

    schema = T.StructType([T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
