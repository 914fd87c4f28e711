"""Packing of documents into sequences of one length: concatenate and cut.

1. Every text becomes ids, with the end id behind it. A partition writes its documents with the number of ids that it
   had before each (the first prefix sum), and its rows carry the partition's number.
2. The partitions' totals are summed up in order (the second prefix sum; a row per partition), so a document's place
   in the concatenation of all is its partition's offset plus its own.
3. Fixed windows are cut from that concatenation. A task cuts whole windows from the rows that it reads; what it has of
   a window at the edge of its rows is a boundary record. Only boundary records meet by the window's number.

Nothing but boundary records is shuffled, about two a partition. All sequences are full but the last.

Texts are encoded by the distinct words of a slice of texts. Where the tokenizer's rules show that it cuts there anyway,
texts are cut into words with byte tables; the tokenizer sees each distinct word, and its ids are put back by position.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import tokenizer
from .common import stage
from .textnum import gather, slices, utf8_parts

SEQUENCE_TOKENS = 4096
#: Bytes of text that are cut into words at once; a longer single text stands alone.
SLICE_BYTES = 6_000_000
#: Words per call of the tokenizer, and words whose ids a worker keeps from slice to slice.
ENCODED_TOGETHER, KEPT_WORDS = 20_000, 400_000

# The normaliser and the pre-tokenizer of vocabularies that lower-case, drop white space and end words.
WORD_END_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE, _LETTER, _DIGIT, _QUOTE, _STICKY, _MARK, _HIGH = range(7)


@lru_cache(maxsize=2)
def _word_end_rules(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Classes of bytes, which pairs of classes a word ends between, and the ids that end a word; None for tokenizers of
    other rules, whose texts are encoded whole.

    Words end at white space, behind ASCII letters and digits, and before ASCII letters and digits that follow other
    ASCII marks. A quote stays with the letters behind it, as both may be a contraction; so do the marks of special
    tokens with their neighbours, and everything that isn't ASCII, as it may be a letter, a mark or an accent.
    """
    own = json.loads(tokenizer(path).to_str())
    normal, split = own["normalizer"] or {}, own["pre_tokenizer"] or {}
    pattern = next((x.get("pattern") for x in split.get("pretokenizers", [])), None)
    suffix = own["model"].get("end_of_word_suffix")
    if normal.get("normalizers") != WORD_END_NORMALIZERS or pattern != {"Regex": WORD_END_PATTERN} or not suffix:
        return None
    kind = np.full(256, _MARK, np.uint8)
    kind[128:] = _HIGH
    kind[:32] = kind[127] = _STICKY
    for c in chain.from_iterable(x["content"] for x in own["added_tokens"]):
        if ord(c) < 128 and not c.isalnum():
            kind[ord(c)] = _STICKY
    for low, high in (("a", "z"), ("A", "Z")):
        kind[ord(low) : ord(high) + 1] = _LETTER
    kind[ord("0") : ord("9") + 1] = _DIGIT
    kind[ord("'")] = _QUOTE
    kind[[9, 10, 13, 32]] = _SPACE
    ends = np.zeros((8, 8), bool)
    for after in (_DIGIT, _QUOTE, _MARK):
        ends[_LETTER, after] = ends[_DIGIT, after] = True
    ends[_DIGIT, _LETTER] = ends[_MARK, _LETTER] = ends[_MARK, _DIGIT] = ends[_QUOTE, _DIGIT] = True
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    last = np.zeros(max(vocab.values()) + 1, bool)
    last[[number for piece, number in vocab.items() if piece.endswith(suffix)]] = True
    return kind, ends.reshape(-1), last


def _words(path: str, raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and the n+1 bounds of each text's words."""
    rules = _word_end_rules(path)
    if rules is None or not len(raw):
        filled = np.flatnonzero(np.diff(off))
        return _strings(raw, np.diff(off)[filled]), np.searchsorted(filled, np.arange(len(off)))
    kinds, ends, _ = rules
    kind = kinds[raw]
    solid = kind != _SPACE
    begin = np.ones(len(raw), bool)
    begin[1:] = ends[kind[:-1] * np.uint8(8) + kind[1:]] | ~solid[:-1]
    begin[off[:-1][off[:-1] < len(raw)]] = True
    begin &= solid
    starts = np.flatnonzero(begin)
    upto = np.zeros(len(raw) + 1, np.int64)  # solid bytes before each place
    np.cumsum(solid, out=upto[1:])
    sizes = np.diff(upto[starts], append=upto[-1])
    data = raw[solid]
    # Words of plain ASCII are lower-cased here, so that fewer are distinct; others by the tokenizer after its accents.
    odd = np.flatnonzero(((kind == _HIGH) | (kind == _STICKY))[solid])
    plain = np.ones(len(starts), bool)
    plain[np.searchsorted(upto[starts], odd, side="right") - 1] = False
    capital = (data >= 65) & (data <= 90)
    if capital.any():
        at = np.flatnonzero(capital)
        at = at[plain[np.searchsorted(upto[starts], at, side="right") - 1]]
        data[at] |= 32
    return _strings(data, sizes), np.searchsorted(starts, off)


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), buffers)


def _ids_of(path: str, words: list[str]) -> list[np.ndarray]:
    """The ids of each word. Words of letters alone are set in a row, one text for many, where each ends with a piece
    that ends a word."""
    rules, out = _word_end_rules(path), [None] * len(words)
    rows = [k for k, w in enumerate(words) if w.isalpha()] if rules else []
    rest = [] if len(rows) == len(words) else sorted(set(range(len(words))) - set(rows))
    for k in range(0, len(rows), ENCODED_TOGETHER):
        some = rows[k : k + ENCODED_TOGETHER]
        found = tokenizer(path).encode_batch_fast([" ".join(words[j] for j in some)], add_special_tokens=False)[0].ids
        found = np.asarray(found, np.uint32)
        last = np.flatnonzero(rules[2][found]) + 1
        if len(last) == len(some):  # every word has one such piece at least
            for j, ids in zip(some, np.split(found, last[:-1]), strict=True):
                out[j] = ids
        else:
            rest += some
    for k in range(0, len(rest), ENCODED_TOGETHER):
        some = rest[k : k + ENCODED_TOGETHER]
        for j, x in zip(some, tokenizer(path).encode_batch_fast([words[j] for j in some], add_special_tokens=False), strict=True):
            out[j] = np.asarray(x.ids, np.uint32)
    return out


_KEPT: dict[tuple[str, int], dict[str, bytes]] = {}


def encode_texts(path: str, column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, in ``width`` bytes each, and the n+1 bounds of the texts; null counts as empty."""
    raw, off = utf8_parts(column)
    words, of_text = _words(path, raw, off)
    coded = pc.dictionary_encode(words)
    kept = _KEPT.setdefault((path, width), {})
    listed = coded.dictionary.to_pylist()
    found = [kept.get(w) for w in listed]
    missing = [k for k, x in enumerate(found) if x is None]
    if missing:
        if len(kept) + len(missing) > KEPT_WORDS:
            kept.clear()
        for k, ids in zip(missing, _ids_of(path, [listed[k] for k in missing]), strict=True):
            found[k] = ids.astype(f"<u{width}").tobytes()
            if len(found[k]) < 64 and len(kept) < KEPT_WORDS:
                kept[listed[k]] = found[k]
    bounds = np.zeros(len(found) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // width, out=bounds[1:])
    values, cut = gather(np.frombuffer(b"".join(found), f"<u{width}"), bounds, np.asarray(coded.indices, np.int64))
    return values, cut[of_text]


def _encode(path: str, end_id: int | None, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, before = TaskContext.get().partitionId(), 0
    for batch in slices(batches, "text", SLICE_BYTES, 20_000):
        values, cut = encode_texts(path, batch.column("text"), width)
        if end_id is not None:
            values = np.insert(values, cut[1:], end_id)
            cut = cut + np.arange(len(cut))
        yield pa.record_batch(
            {
                "part": pa.array(np.full(batch.num_rows, part, np.int32)),
                "before": pa.array(before + cut[:-1]),
                "id": batch.column("id"),
                "n": pa.array(np.diff(cut)),
                "ids": pa.Array.from_buffers(
                    pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut * width), pa.py_buffer(np.ascontiguousarray(values))]
                ).cast(pa.binary()),
            }
        )
        before += int(cut[-1])


def _fragments(size: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the rows' ids, and what there is of those at the ends of gapless runs of rows."""
    flat: list[np.ndarray] = []  # of the open window
    pieces: list[dict] = []
    opened, at = 0, -1  # where the open window's ids begin, and where the next row must

    def out() -> pa.RecordBatch | None:
        if at <= opened:
            return None
        return pa.record_batch(
            {
                "sequence_id": pa.array([opened // size], pa.int64()),
                "first": pa.array([opened % size], pa.int64()),
                "n_tokens": pa.array([at - opened], pa.int64()),
                "ids": pa.array([np.concatenate(flat).astype("<u4").tobytes()], pa.binary()),
                "pieces": pa.array([pieces], pa.list_(kind)),
            }
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = pa.struct(
            [("id", batch.schema.field("id").type), *((x, pa.int64()) for x in ("start", "length", "offset", "doc_tokens"))]
        )
        start, n = np.asarray(batch.column("start")), np.asarray(batch.column("n"))
        ids = batch.column("id").to_pylist()
        for k in range(batch.num_rows):
            if start[k] != at:
                if (row := out()) is not None:
                    yield row
                opened, flat, pieces = int(start[k]), [], []
                at = opened
            doc, done, total = np.frombuffer(batch.column("ids")[k].as_py(), f"<u{width}"), 0, int(n[k])
            while done < total:
                take = min(total - done, size - at % size)
                flat.append(doc[done : done + take])
                pieces.append({"id": ids[k], "start": done, "length": take, "offset": at % size, "doc_tokens": total})
                done, at = done + take, at + take
                if at % size == 0:
                    yield out()
                    opened, flat, pieces = at, [], []
    if flat:
        yield out()


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = None,
    size: int = SEQUENCE_TOKENS,
    pad_id: int | None = None,
) -> DataFrame:
    """Sequences of ``size`` ids that hold all documents, one behind another in the order of the table's partitions.

    Returns ``sequence_id`` (from 0, gapless), ``n_tokens`` (``size`` but in the last), ``ids`` (little-endian unsigned
    32-bit integers) and ``pieces``, an array in order: ``id``, ``start`` (the document's ids before the piece),
    ``length``, ``offset`` (in the sequence) and ``doc_tokens``. With ``pad_id`` the last sequence's ``ids`` are filled up
    to ``size``, unless their number is a power of two.

    * Null and empty texts are the end id alone, and in no sequence where there is none. Texts are encoded whole; very
      long ones spread over many sequences.
    * Null and repeated ids are carried through; each row is packed. Other columns are ignored.
    * An empty table gives no sequence.
    """
    id_type = docs.schema[id_col].dataType
    size_of_vocabulary = max(tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True), (end_id or 0) + 1)
    width = 2 if size_of_vocabulary <= 1 << 16 else 4
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("before", T.LongType()),
            T.StructField("id", id_type),
            T.StructField("n", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    coded = stage(rows.mapInArrow(lambda b: _encode(tokenizer_path, end_id, width, b), schema), "packing-ids", compression="zstd")

    totals = coded.groupBy("part").agg(F.sum("n").alias("total"))
    offset = F.sum("total").over(Window.orderBy("part")) - F.col("total")  # a row per partition of the table
    offsets = totals.select("part", offset.alias("offset"))
    placed = coded.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("before")).alias("start"), "id", "n", "ids")
    piece = T.StructType([T.StructField("id", id_type), *(T.StructField(x, T.LongType()) for x in ("start", "length", "offset", "doc_tokens"))])
    cut_schema = T.StructType(
        [
            *(T.StructField(x, T.LongType()) for x in ("sequence_id", "first", "n_tokens")),
            T.StructField("ids", T.BinaryType()),
            T.StructField("pieces", T.ArrayType(piece)),
        ]
    )
    cut = stage(placed.mapInArrow(lambda b: _fragments(size, width, b), cut_schema), "packing-windows", compression="zstd")

    whole = F.col("n_tokens") == size
    # A window has as many boundary records as runs of rows met in it, of one id each at least.
    edges = cut.filter(~whole).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("first", "n_tokens", "ids", "pieces"))).alias("x"))
    joined = edges.select(
        "sequence_id",
        F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + x["n_tokens"]).alias("n_tokens"),
        F.aggregate("x", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"),
        F.flatten(F.transform("x", lambda x: x["pieces"])).alias("pieces"),
    )
    out = cut.filter(whole).drop("first").unionByName(joined)
    if pad_id is not None:
        power = F.bit_count("n_tokens") == 1
        fill = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (size - F.col("n_tokens")).cast("int")))
        out = out.withColumn("ids", F.when(power, F.col("ids")).otherwise(F.concat("ids", fill)))
    return out


def piece_table(sequences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per piece of packed sequences: ``id_col``, ``start``, ``length``, ``ids_crc32`` (of the piece's ids as they
    stand in the sequence), ``doc_tokens``, ``sequence_id``, ``offset``."""
    crc = lambda p: F.crc32(F.substring("ids", (4 * p["offset"] + 1).cast("int"), (4 * p["length"]).cast("int")))
    found = sequences.select("sequence_id", F.explode(F.transform("pieces", lambda p: F.struct(p.alias("p"), crc(p).alias("c")))).alias("x"))
    return found.select(
        F.col("x.p.id").alias(id_col),
        F.col("x.p.start").alias("start"),
        F.col("x.p.length").alias("length"),
        F.col("x.c").alias("ids_crc32"),
        F.col("x.p.doc_tokens").alias("doc_tokens"),
        "sequence_id",
        F.col("x.p.offset").alias("offset"),
    )
