"""BPE encoding and decoding by a distinct-word table.

1. Spark splits every text into the tokenizer's words (its pre-tokenizer's pattern, as a JVM expression).
2. The words of a block of documents (one Arrow batch) become numbers into the block's own word list, so a
   document is a row of positions. The word lists are dealt out by a hash of the word.
3. Each bucket of words meets the same words of all blocks, encodes every distinct word once, and sends the ids
   back to the blocks under the words' positions.
4. Each block joins ids to positions, and pieces to ids for decoding (a table as large as the vocabulary).

What moves is one compact number per word of text and one entry per distinct word and block. A frequent word
has one entry per block, so no bucket is hotter than others. Blocks and buckets are bounded by parameters.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textnum import PIECE_BYTES, gather, span_hashes, utf8_parts

# The white space of Unicode, and the word pattern of byte-level BPE vocabularies.
WHITE_SPACE = "\t-\r \u0085   -     　"
# Letters and numbers come first, as they can't begin where a contraction does; what needn't be given back isn't.
WORD_PATTERN = (
    r" ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^" + WHITE_SPACE + r"\p{L}\p{N}]++"
    r"|[" + WHITE_SPACE + r"]+(?![^" + WHITE_SPACE + r"])|[" + WHITE_SPACE + r"]+"
)

#: Words of a block at most, unless a single document has more.
BLOCK_WORDS = 4_000_000
#: Words of a block that are numbered, or put back, at once: arrays over words and bytes are wider than what they become.
PIECE_WORDS = 100_000
#: Words per call of the tokenizer, whose results are large objects.
ENCODED_TOGETHER = 20_000
#: Bytes of text per bucket of words, about, and most buckets: every block has a pack for each.
BUCKET_BYTES, MOST_BUCKETS = 16_000_000, 4096


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a vocabulary file, kept per Python worker; one thread, as Spark runs the tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def special_tokens(path: str) -> list[str]:
    """Strings that the tokenizer takes out of a text before it splits words."""
    return [x["content"] for x in json.loads(tokenizer(path).to_str())["added_tokens"]]


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces in id order, and their bounds."""
    # A byte-level vocabulary writes printable bytes as themselves and the others from U+0100 on.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for piece, number in vocab.items():
        known = all(c in byte_of for c in piece)
        out[number] = bytes(byte_of[c] for c in piece) if known else piece.encode()
    bounds = np.zeros(len(out) + 1, np.int64)
    np.cumsum([len(x) for x in out], out=bounds[1:])
    return np.frombuffer(b"".join(out), np.uint8), bounds


def words_column(text: Column, specials: list[str]) -> Column:
    """The tokenizer's words of a text, in order; joined they give the text. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    split = lambda t: F.regexp_extract_all(t, F.lit(WORD_PATTERN), F.lit(0))
    out = split(text)
    if specials:
        any_special = "|".join("".join(c if c.isalnum() else "\\" + c for c in s) for s in specials)
        marks = F.regexp_extract_all(text, F.lit(any_special), F.lit(0))
        between = F.transform(F.split(text, any_special, -1), split)
        mixed = F.flatten(
            F.zip_with(between, marks, lambda w, s: F.when(s.isNull(), w).otherwise(F.concat(w, F.array(s))))
        )
        has = None
        for s in specials:
            has = F.contains(text, F.lit(s)) if has is None else has | F.contains(text, F.lit(s))
        out = F.when(has, mixed).otherwise(out)
    return out


def _encode_each(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes, values = [], [np.zeros(0, np.uint32)]
    for k in range(0, len(words), ENCODED_TOGETHER):
        found = [x.ids for x in tokenizer(path).encode_batch_fast(words[k : k + ENCODED_TOGETHER], add_special_tokens=False)]
        sizes.extend(map(len, found))
        values.append(np.fromiter(chain.from_iterable(found), np.uint32))
    return np.concatenate(values), _bounds(np.asarray(sizes, np.int64))


def _encode_in_a_row(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_encode_each`, for words that each begin with a space and have no other. Set in a row they are one
    text, which the tokenizer splits into the same words, and a piece that begins with a space begins a word."""
    text, edges = pieces(path)
    filled = np.flatnonzero(np.diff(edges))
    spaced = np.zeros(len(edges) - 1, bool)
    spaced[filled] = text[edges[filled]] == 32
    values, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for k in range(0, len(words), ENCODED_TOGETHER):
        some = words[k : k + ENCODED_TOGETHER]
        ids = np.array(tokenizer(path).encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.uint32)
        begins = np.flatnonzero(spaced[ids])
        if len(begins) == len(some):
            values.append(ids)
            sizes.append(np.diff(begins, append=len(ids)))
        else:  # a pre-tokenizer that splits otherwise
            ids, cut = _encode_each(path, some)
            values.append(ids)
            sizes.append(np.diff(cut))
    return np.concatenate(values), _bounds(np.concatenate(sizes))


def encode_words(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words that each stand alone: all ids, and their bounds."""
    plain = np.fromiter((len(w) > 1 and w[0] == " " and not w[1].isspace() for w in words), bool, len(words))
    plain &= "add_prefix_space\":false" in _settings(path)
    first, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
    a, cut_a = _encode_in_a_row(path, [words[k] for k in first])
    b, cut_b = _encode_each(path, [words[k] for k in rest])
    place = np.empty(len(words), np.int64)
    place[np.concatenate([first, rest])] = np.arange(len(words))
    return gather(np.concatenate([a, b]), np.concatenate([cut_a, cut_b[1:] + cut_a[-1]]), place)


@lru_cache(maxsize=2)
def _settings(path: str) -> str:
    """The pre-tokenizer's settings, without spaces."""
    return json.dumps(json.loads(tokenizer(path).to_str())["pre_tokenizer"], separators=(",", ":"))


def list_parts(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat values and the n+1 bounds of a list column without nulls."""
    off = np.asarray(column.offsets, np.int64)
    return column.values.slice(off[0], off[-1] - off[0]), off - off[0]


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays of any lengths, each compressed by itself."""
    one = {k: pa.LargeListArray.from_arrays(pa.array([0, len(v)], pa.int64()), pa.array(v)) for k, v in arrays.items()}
    return _ipc(pa.record_batch(one))


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(raw).read_all()
    return {k: np.asarray(table[k].combine_chunks().flatten()) for k in table.column_names}


def _narrow(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the smallest width that holds them."""
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A large binary column whose row i is values[bounds[i]:bounds[i+1]]."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * width), pa.py_buffer(np.ascontiguousarray(values))]
    )


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(_bounds(sizes)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), buffers)


def _cut_blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    part, count = TaskContext.get().partitionId(), 0
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            _, sizes = list_parts(whole.column("words"))
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BLOCK_WORDS, side="right")) - 1)
            yield _block((part << 32) + count, whole.slice(at, to - at), buckets)
            at = to
            count += 1
        del whole  # before the next batch is read


def _numbers(flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of each word, and the distinct words: bytes, bounds and numbers."""
    # The chunks share one dictionary.
    chunks = [flat.slice(k, PIECE_WORDS) for k in range(0, len(flat), PIECE_WORDS)] or [flat]
    coded = pc.dictionary_encode(pa.chunked_array(chunks)).chunks
    raw, off = utf8_parts(coded[-1].dictionary)
    # A word's number is its rank by frequency in the block, so most positions have small numbers.
    order = np.argsort(-sum(np.bincount(np.asarray(x.indices), minlength=len(off) - 1) for x in coded), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    numbers, to_number = np.empty(len(flat), "<u4"), rank.astype("<u4")
    for k, x in enumerate(coded):
        numbers[k * PIECE_WORDS :][: len(x)] = to_number[np.asarray(x.indices)]
    return numbers, raw, off, rank


def _hashes(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashes of words, worked out over pieces of about ``PIECE_BYTES``."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + PIECE_BYTES, side="right")) - 1)
        some = off[at : to + 1] - off[at]
        out.append(span_hashes(raw[off[at] : off[to]], some[:-1], some[1:], fold_case=False))
        at = to
    return np.concatenate(out)


def _block(block: int, batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """The rows of one block: its documents, and a pack of words for each bucket."""
    flat, bounds = list_parts(batch.column("words"))
    numbers, raw, off, rank = _numbers(flat)
    bucket = (_hashes(raw, off) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((rank, bucket))
    rank_of, edges = rank[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = np.flatnonzero(edges[1:] > edges[:-1])
    rows = []
    for b in used:
        x, y = edges[b], edges[b + 1]
        data, cut = gather(raw, off, order[x:y])
        rows.append(_pack(data=data, size=_narrow(np.diff(cut)), step=_narrow(np.diff(rank_of[x:y], prepend=0))))
    planes = {f"byte{k}": numbers.view(np.uint8)[k::4] for k in range(4)}
    n = len(rows)
    return pa.record_batch(
        {
            "block": pa.array([block] * (n + 1), pa.int64()),
            "key": pa.array([-1 - block, *used.tolist()], pa.int64()),
            "pack": pa.array([_pack(size=_narrow(np.diff(bounds)), **planes), *rows], pa.binary()),
            "ids": pa.array([_ipc(pa.record_batch({"id": batch.column("id")}))] + [None] * n, pa.binary()),
        }
    )


def _encode_bucket(path: str, group: pa.Table) -> pa.Table:
    """Ids for the words of a bucket, pack by pack; the documents of a block pass through."""
    if group["key"][0].as_py() < 0:
        return group.select(["block", "pack", "ids"])
    packs = [_unpack(x.as_py()) for x in group["pack"]]
    coded = pc.dictionary_encode(pa.concat_arrays([_strings(p["data"], p["size"]) for p in packs]))
    values, bounds = encode_words(path, coded.dictionary.to_pylist())
    index = np.asarray(coded.indices, np.int64)
    out, at = [], 0
    for p in packs:
        ids, cut = gather(values, bounds, index[at : at + len(p["size"])])
        at += len(p["size"])
        out.append(_pack(ids=_narrow(ids), size=_narrow(np.diff(cut)), step=p["step"]))
    return pa.table({"block": group["block"], "pack": pa.array(out, pa.binary()), "ids": pa.nulls(len(out), pa.binary())})


def _assemble(path: str, id_type: pa.DataType, decode: bool, id_bytes: int, group: pa.Table) -> Iterator[pa.RecordBatch]:
    is_docs = pc.is_valid(group["ids"])
    docs, packs = group.filter(is_docs), group.filter(pc.invert(is_docs))
    parts = [_unpack(x.as_py()) for x in packs["pack"]]
    none = np.zeros(0, np.int64)
    values = np.concatenate([p["ids"].astype(np.uint32) for p in parts] or [none])
    bounds = _bounds(np.concatenate([p["size"] for p in parts] or [none]))
    rank = np.concatenate([np.cumsum(p["step"], dtype=np.int64) for p in parts] or [none])
    values, bounds = gather(values, bounds, np.argsort(rank))
    text, edges = pieces(path)
    table = _unpack(docs["pack"][0].as_py())
    where = np.stack([table[f"byte{k}"] for k in range(4)], axis=1).view("<u4")[:, 0]
    rows = _bounds(table["size"])
    del table
    ids = pa.ipc.open_stream(docs["ids"][0].as_py()).read_all()["id"].combine_chunks()
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(rows, rows[at] + PIECE_WORDS, side="right")) - 1)
        got, cut = gather(values, bounds, where[rows[at] : rows[to]])
        of_doc = cut[rows[at : to + 1] - rows[at]]
        out = {
            "id": ids.slice(at, to - at).cast(id_type),
            "n_tokens": pa.array(np.diff(of_doc)),
            "ids": _binary(got.astype(f"<u{id_bytes}"), of_doc).cast(pa.binary()),
        }
        if decode:
            raw, piece_cut = gather(text, edges, got)
            back = [
                raw[a:b].tobytes().decode("utf-8", "replace")
                for a, b in zip(piece_cut[of_doc[:-1]], piece_cut[of_doc[1:]], strict=True)
            ]
            out["text"] = pa.array(back, pa.string())
        yield pa.record_batch(out)
        at = to


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, from one scan of their column."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def bucket_number(docs: DataFrame, size: int) -> int:
    """One bucket per ``BUCKET_BYTES`` of text, but ``MOST_BUCKETS`` at most and eight per shuffle partition at least."""
    least = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_BUCKETS, size // BUCKET_BYTES))


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
    decode: bool = True,
    id_bytes: int = 4,
) -> DataFrame:
    """Encode every text, and decode the ids again.

    Returns one row per input row: ``id_col``, ``n_tokens``, ``ids`` (little-endian unsigned integers of ``id_bytes``
    bytes) and, with ``decode``, ``text`` (the decoded ids). ``buckets``: shares of the distinct-word table, by default
    as :func:`bucket_number` has it.

    * Null and empty texts give no ids and an empty text. Texts of any length are encoded whole.
    * Special tokens of the vocabulary that occur in a text become their ids, as in the tokenizers library.
    * Null and repeated ids are carried through; repeated rows each get their row.
    * An empty table gives an empty result; further columns of ``docs`` are ignored.
    """
    buckets = buckets or bucket_number(docs, text_bytes(docs, text_col))
    id_type = docs.schema[id_col].dataType
    words = docs.select(
        F.col(id_col).alias("id"), words_column(F.col(text_col), special_tokens(tokenizer_path)).alias("words")
    )
    # One chain without a second reader, so blocks and their packs always come from one run of a task.
    blocks = words.mapInArrow(
        lambda batches: _cut_blocks(batches, buckets), "block long, key long, pack binary, ids binary"
    )
    coded = blocks.groupBy("key").applyInArrow(
        lambda group: _encode_bucket(tokenizer_path, group), "block long, pack binary, ids binary"
    )
    arrow_id = arrow_type(id_type)

    # The rows of a block are handed on piece by piece: together they are much larger than its packs.
    def assemble(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _assemble(tokenizer_path, arrow_id, decode, id_bytes, pa.Table.from_batches(list(group)))

    schema = [T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if decode:
        schema.append(T.StructField("text", T.StringType()))
    out = coded.groupBy("block").applyInArrow(assemble, T.StructType(schema))
    return out.withColumnRenamed("id", id_col)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def decode_documents(rows: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id sequences (binary columns of little-endian unsigned 32-bit integers): ``id_col``, ``text``.

    Pieces join their ids inside the tasks, as the table is no larger than the vocabulary. Bytes that are no
    UTF-8 become U+FFFD; null and empty sequences give an empty text; an id outside the vocabulary is an error.
    """
    id_type = rows.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, edges = pieces(tokenizer_path)
        for batch in batches:
            back = []
            for x in batch.column("ids"):
                ids = np.frombuffer(x.as_py() or b"", "<u4").astype(np.int64)
                back.append(gather(text, edges, ids)[0].tobytes().decode("utf-8", "replace"))
            yield pa.record_batch({"id": batch.column("id"), "text": pa.array(back, pa.string())})

    schema = T.StructType([T.StructField("id", id_type), T.StructField("text", T.StringType())])
    out = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
