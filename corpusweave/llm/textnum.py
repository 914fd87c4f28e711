"""Vectorised hashing of words and bytes in Arrow string columns (numpy, inside tasks).

A word's hash is a polynomial over random values of its bytes, modulo 2**64, then mixed. With an odd
multiplier the powers have inverses, so one running sum over the buffer gives every word's polynomial.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at once; a longer single text stands alone.
CHUNK_BYTES = 2_000_000
#: The same for the stages of the pipeline: arrays over bytes are eight times as large, and several of them live at once.
PIECE_BYTES = 500_000
_MULTIPLIER = 0x9E3779B97F4A7C15


def utf8_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES, rows: int = 2000
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column`` and ``rows`` rows at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8_parts(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            to = min(to, at + rows)
            yield batch.slice(at, to - at)
            at = to


@lru_cache(maxsize=4)
def _byte_values(fold_case: bool) -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    if fold_case:
        values[65:91] = values[97:123]
    return values


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_MULTIPLIER, -1, 2**64)
        size = 1 << max(n - 1, PIECE_BYTES).bit_length()
        _POWERS[:] = []
        for base in (_MULTIPLIER, inverse):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS.append(np.multiply.accumulate(out))
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_spans(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes within each text, and the text of each run."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = is_word[raw]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    before &= ~cut[:n]
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after &= ~cut[1:]
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, by default blind to ASCII case."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_byte_values(fold_case)[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gather(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ragged rows: row i of the source is values[bounds[i]:bounds[i+1]]. Also the new bounds."""
    lens = (bounds[1:] - bounds[:-1])[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(bounds[:-1][which] - out[:-1], lens)
    return values[at], out


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ragged rows that ``bounds`` marks; empty rows give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
