"""Fill-in-middle transformation over seekable compressed frames.

A document is stored as independent zstandard frames with the number of units (lines), of code points and of bytes before
each. The cut points of a document are unit numbers, so the counts tell which frame holds a cut, and only that
frame is decompressed to find it. The output is a list of frames again: those between the cuts are taken over
as they are, a cut frame is parted into two, and the marks are frames of their own. Digests, and the way back from an output
to its text, read frames one after another. So what a task holds of a document is its compressed frames and one frame's text.

A document is one row from the table to the output, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

#: Bytes of text per frame, about: frames end between code points, and with a line where one ends in their last quarter.
FRAME_BYTES = 128 * 1024
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_MARKS = (PREFIX, SUFFIX, MIDDLE)
_LISTS = ("units", "chars", "sizes")


@lru_cache(maxsize=1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One pair per Python worker."""
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True), zstandard.ZstdDecompressor()


def _frame_ends(text: bytes, size: int) -> Iterator[int]:
    """Where frames of a text end."""
    at = 0
    while len(text) - at > size:
        to = at + size
        line = text.rfind(b"\n", at + size * 3 // 4, to) + 1
        if line:
            to = line
        else:
            while text[to] & 0xC0 == 0x80:  # within a code point
                to -= 1
        yield to
        at = to
    if len(text) > at:
        yield len(text)


def _code_points(text: bytes) -> int:
    return len(text.decode("utf-8"))


def _stored(text: bytes, size: int, packer: zstandard.ZstdCompressor) -> dict:
    """Frames of a text, and what lies before each and after the last: finished lines, code points and bytes."""
    frames, units, chars, sizes, at = [], [0], [0], [0], 0
    for to in _frame_ends(text, size):
        part = text[at:to]
        frames.append(packer.compress(part))
        units.append(units[-1] + part.count(b"\n"))
        chars.append(chars[-1] + _code_points(part))
        sizes.append(to)
        at = to
    last = len(text) > 0 and not text.endswith(b"\n")  # a line without an end counts as a unit too
    return {"frames": frames, "units": units, "chars": chars, "sizes": sizes, "n": units[-1] + last, "marked": any(m in text for m in _MARKS)}


def frame_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Every text as seekable frames of ``frame_bytes`` (4 at least), written to the shared folder: ``id_col``, ``frames``, the
    counts ``units``, ``chars`` and ``sizes`` (before each frame and after the last), ``n`` (units) and ``marked`` (holds a mark
    of the transformation).

    Null and empty texts have no frame and no unit. Null and repeated ids are carried through; an empty table gives an
    empty store; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, _ = _codec()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [_stored(x.as_py() or b"", frame_bytes, packer) for x in part.column("text")]
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "frames": pa.array([r["frames"] for r in rows], pa.list_(pa.binary())),
                        **{k: pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in _LISTS},
                        "n": pa.array([r["n"] for r in rows], pa.int64()),
                        "marked": pa.array([r["marked"] for r in rows], pa.bool_()),
                    }
                )

    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("frames", T.ArrayType(T.BinaryType())),
            *(T.StructField(k, T.ArrayType(T.LongType())) for k in _LISTS),
            T.StructField("n", T.LongType()),
            T.StructField("marked", T.BooleanType()),
        ]
    )
    rows = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    # Frames are compressed already.
    return stage(rows.mapInArrow(run, schema), "frames", compression="uncompressed").withColumnRenamed("id", id_col)


class _Reader:
    """Frames of one document; ``opened`` counts those that were decompressed to find a cut."""

    def __init__(self, frames: list[bytes], units: list[int], chars: list[int], n: int):
        self.frames, self.units, self.chars, self.n = frames, units, chars, n
        self.opened = 0
        self.packer, self.opener = _codec()
        self.held: tuple[int, bytes] = (-1, b"")

    def text(self, k: int) -> bytes:
        if self.held[0] != k:
            self.held = (k, self.opener.decompress(self.frames[k]))
            self.opened += 1
        return self.held[1]

    def find(self, unit: int) -> tuple[int, int, int]:
        """Where the text's first ``unit`` units end: frame, byte in it, code points before."""
        if unit == 0:
            return 0, 0, 0
        if unit >= self.n:
            return len(self.frames), 0, self.chars[-1]
        # The frame in which the unit's line end lies: the last one with fewer ends before it.
        k = bisect_right(self.units, unit - 1) - 1
        text, at = self.text(k), 0
        for _ in range(unit - self.units[k]):
            at = text.index(b"\n", at) + 1
        return k, at, self.chars[k] + _code_points(text[:at])

    def part(self, begin: tuple[int, int, int], end: tuple[int, int, int]) -> list[bytes]:
        """Frames of the text between two places; whole ones as they are stored."""
        (k, x, _), (m, y, _) = begin, end
        if k == m:
            return [self.packer.compress(self.text(k)[x:y])] if y > x else []
        out = [self.packer.compress(self.text(k)[x:])] if x else self.frames[k : k + 1]
        out = out + self.frames[k + 1 : m]
        return out + [self.packer.compress(self.text(m)[:y])] if y else out


def _transformed(reader: _Reader, form: str, cuts: tuple[int, int]) -> tuple[list[bytes], int | None, int | None]:
    if form == "plain":
        return reader.frames, None, None
    ends = (0, 0, 0), reader.find(cuts[0]), reader.find(cuts[1]), (len(reader.frames), 0, reader.chars[-1])
    prefix, middle, suffix = (reader.part(ends[k], ends[k + 1]) for k in range(3))
    p, s, m = (reader.packer.compress(x) for x in (PREFIX, SUFFIX, MIDDLE))
    out = [p, *prefix, s, *suffix, m, *middle] if form == "psm" else [s, *suffix, p, *prefix, m, *middle]
    return out, ends[1][2], ends[2][2] - ends[1][2]


def _numbers(seed: int, doc_id: object) -> list[int]:
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[8 * k : 8 * k + 8], 16) for k in range(4)]


def fill_in_middle(store: DataFrame, seed: int, rate: int = 100, spm: int = 50, id_col: str = "doc_id") -> DataFrame:
    """The transformed text of every row of a :func:`frame_store`: ``id_col``, ``n``, ``form``, ``prefix_chars``,
    ``middle_chars`` (null if plain) and ``output`` (frames).

    Of a hundred texts ``rate`` are transformed, and ``spm`` of a hundred of those with the suffix first; cuts and forms follow
    from a hash of ``seed`` and the id, so repeated rows of one id and text come out alike, and a null id counts as an empty
    one. Empty texts, and those that hold a mark, stay as they are.
    """
    id_type = store.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("form", "prefix_chars", "middle_chars", "output")}
            for r in batch.to_pylist():
                h, n = _numbers(seed, r["id"]), r["n"]
                form = "plain" if not n or r["marked"] or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm else "psm"
                reader = _Reader(r["frames"], r["units"], r["chars"], n)
                frames, before, between = _transformed(reader, form, tuple(sorted((h[0] % (n + 1), h[1] % (n + 1)))))
                for k, v in zip(out, (form, before, between, frames), strict=True):
                    out[k].append(v)
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "n": batch.column("n"),
                    "form": pa.array(out["form"], pa.string()),
                    "prefix_chars": pa.array(out["prefix_chars"], pa.int64()),
                    "middle_chars": pa.array(out["middle_chars"], pa.int64()),
                    "output": pa.array(out["output"], pa.list_(pa.binary())),
                }
            )

    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.ArrayType(T.BinaryType())),
        ]
    )
    return store.withColumnRenamed(id_col, "id").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def stream(frames: list[bytes]) -> Iterator[bytes]:
    """The text of frames, one after another."""
    _, opener = _codec()
    for x in frames:
        yield opener.decompress(x)


def _marks(frames: list[bytes], wanted: tuple[bytes, ...]) -> list[int]:
    """Where each mark, in this order, begins in the text of the frames. A mark may lie across frames; the texts between
    hold none, and no mark can overlap another, so the first place found is the mark's."""
    found, done, kept = [], 0, b""
    for text in stream(frames):
        window = kept + text
        at = 0
        while len(found) < len(wanted) and (k := window.find(wanted[len(found)], at)) >= 0:
            found.append(done + k)
            at = k + len(wanted[len(found) - 1])
        if len(found) == len(wanted):
            break
        kept = window[max(at, len(window) - 2) :]
        done += len(window) - len(kept)
    return found


def _between(frames: list[bytes], begin: int, end: int | None) -> Iterator[bytes]:
    """Text of the frames from byte ``begin`` to byte ``end``; frames outside aren't decompressed."""
    _, opener = _codec()
    at = 0
    for x in frames:
        size = zstandard.frame_content_size(x)
        if at + size > begin and (end is None or at < end):
            yield opener.decompress(x)[max(0, begin - at) : None if end is None else end - at]
        at += size


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The original text of an output, piece by piece, from nothing but the output and its form."""
    if form == "plain":
        yield from stream(frames)
        return
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    first, second, third = _marks(frames, order)
    a, b = (first + 3, second), (second + 3, third)
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    for begin, end in (prefix, (third + 3, None), suffix):
        yield from _between(frames, begin, end)


def _digest(parts: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for x in parts:
        h.update(x)
    return h.hexdigest()


def digests(outputs: DataFrame) -> DataFrame:
    """``outputs`` without ``output``, with ``output_sha256`` and ``restored_sha256`` (lowercase hex): of the output, and of
    the text that :func:`restored` rebuilds from it."""
    kept = [c for c in outputs.columns if c != "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames, forms = batch.column("output").to_pylist(), batch.column("form").to_pylist()
            out = batch.select(kept)
            out = out.append_column("output_sha256", pa.array([_digest(stream(x)) for x in frames], pa.string()))
            yield out.append_column("restored_sha256", pa.array([_digest(restored(x, f)) for x, f in zip(frames, forms)], pa.string()))

    schema = T.StructType(
        [*(outputs.schema[c] for c in kept), T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]
    )
    return outputs.mapInArrow(run, schema)


def texts(outputs: DataFrame, frames_col: str = "output", text_col: str = "text") -> DataFrame:
    """``outputs`` with the frames' whole text as ``text_col`` instead of ``frames_col``."""
    kept = [c for c in outputs.columns if c != frames_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b"".join(stream(x)).decode("utf-8") for x in batch.column(frames_col).to_pylist()]
            yield batch.select(kept).append_column(text_col, pa.array(found, pa.string()))

    return outputs.mapInArrow(run, T.StructType([*(outputs.schema[c] for c in kept), T.StructField(text_col, T.StringType())]))
