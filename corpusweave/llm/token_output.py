"""Token-id files with canonical, length-limited Huffman codes.

Writing: texts become ids (each distinct word is encoded once, see :mod:`.bpe`), the documents' ids are sorted over
range partitions, and each partition is cut into segments of a bounded number of tokens. Token counts
are summed over all segments; their table is no larger than the vocabulary, and package-merge turns it into
code lengths of at most ``MAX_BITS``. Each segment is then coded on its own.

A segment of the file format (one row of a Parquet file in the output folder):

* ``part``, ``segment``: its place; ``first_token``: tokens of its part before it; ``n_tokens``
* ``doc_ids``, ``doc_tokens``: the documents in order and their token counts
* ``payload``: the codes, most significant bit first, padded to whole 32-bit big-endian words
* ``checkpoints``: the bit offset of every ``BLOCK_TOKENS``-th token, where decoding can start

Beside the segments lie ``lengths`` (code length per id; canonical codes follow from them) and ``parts`` (tokens
before each part). Decoding walks all blocks of a segment in step, with one table look-up per token.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _binary, bucket_number, encode_documents, list_parts, text_bytes, tokenizer
from .common import discard, release, scratch_dir, stage

MAX_BITS = 18
BLOCK_TOKENS = 128
SEGMENT_TOKENS = 1 << 18
#: Bytes of text per range partition, about.
RANGE_BYTES = 64_000_000


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with at most ``max_bits`` bits (package-merge); 0 where a count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need more than {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    # Each round merges the packages of the last one with the single symbols; kinds says which was which.
    kinds, current = [], weights
    for _ in range(max_bits - 1):
        paired = current[: len(current) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, paired])
        order = np.argsort(both, kind="stable")
        kinds.append(order < len(weights))
        current = both[order]
    take = 2 * len(used) - 2
    lengths = np.zeros(len(used), np.int64)
    for single in reversed(kinds):
        n = int(single[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    lengths[:take] += 1
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id): each is the last one plus one, widened to its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    ordered = lengths[order].astype(np.int64)
    codes = np.zeros(len(lengths), np.uint32)
    if len(order):
        step = np.left_shift(np.int64(1), int(ordered[-1]) - ordered)
        start = np.concatenate([[0], np.cumsum(step)[:-1]])
        codes[order] = start >> (int(ordered[-1]) - ordered)
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded ids as big-endian 32-bit words, and the bit offset of each block."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    words = np.zeros(int(ends[-1] if len(ends) else 0) // 32 + 3, np.uint64)
    if len(ids):
        # A code shifted into the 64 bits from the 32-bit word that it starts in.
        word = starts >> 5
        wide = codes[ids].astype(np.uint64) << (64 - (starts & 31) - n).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        joined = np.bitwise_or.reduceat(wide, first)
        words[word[first]] |= joined >> np.uint64(32)
        words[word[first] + 1] |= joined & np.uint64(0xFFFFFFFF)
    return words.astype(">u4"), starts[::BLOCK_TOKENS]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every possible run of the longest code's bits: the id that it starts with, and its length."""
    longest = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    repeat = np.left_shift(1, longest - lengths[order].astype(np.int64))
    symbol = np.zeros(1 << longest, np.uint32)
    width = np.ones(1 << longest, np.int64)
    symbol[: repeat.sum()] = np.repeat(order, repeat)
    width[: repeat.sum()] = np.repeat(lengths[order].astype(np.int64), repeat)
    return symbol, width, longest


def unpack_bits(payload: bytes, checkpoints: np.ndarray, n_tokens: int, table) -> np.ndarray:
    """The ids of a segment: every block starts at its checkpoint, all blocks advance together."""
    symbol, width, longest = table
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    wide = (words[:-1] << np.uint64(32)) | words[1:]
    out = np.zeros((BLOCK_TOKENS, len(checkpoints)), np.uint32)
    at = checkpoints.astype(np.int64)
    last = n_tokens - BLOCK_TOKENS * (len(checkpoints) - 1)
    for k in range(min(BLOCK_TOKENS, n_tokens)):
        if k == last:  # the last block is shorter
            at = at[:-1]
        bits = (wide[at >> 5] >> (64 - longest - (at & 31)).astype(np.uint64)).astype(np.int64) & ((1 << longest) - 1)
        out[k, : len(at)] = symbol[bits]
        at = at + width[bits]
    return out.T.reshape(-1)[:n_tokens]


def _segments(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a sorted partition into segments of about SEGMENT_TOKENS tokens, whole documents each."""
    docs: list[pa.Array] = []
    ids: list[np.ndarray] = []
    lens: list[np.ndarray] = []
    part, held, first, number = None, 0, 0, 0

    def out() -> pa.RecordBatch:
        return pa.record_batch(
            {
                "part": pa.array([part], pa.int32()),
                "segment": pa.array([number], pa.int32()),
                "first_token": pa.array([first], pa.int64()),
                "n_tokens": pa.array([held], pa.int64()),
                "doc_ids": pa.array([pa.concat_arrays(docs).to_pylist()], pa.list_(docs[0].type)),
                "doc_tokens": pa.array([np.concatenate(lens)], pa.list_(pa.int64())),
                "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()),
            }
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        column = batch.column("ids").cast(pa.large_binary())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // width
        flat = np.frombuffer(column.buffers()[2] or b"", f"<u{width}")[: off[-1]]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + SEGMENT_TOKENS - held, side="right")) - 1)
            docs.append(batch.column("id").slice(at, to - at))
            ids.append(flat[off[at] : off[to]])
            lens.append(np.diff(off[at : to + 1]))
            held += int(off[to] - off[at])
            at = to
            if held >= SEGMENT_TOKENS or at < batch.num_rows:
                yield out()
                first, number, held, docs, ids, lens = first + held, number + 1, 0, [], [], []
    if docs:
        yield out()


def _encode(lengths: np.ndarray, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = canonical_codes(lengths)
    for batch in batches:
        for k in range(batch.num_rows):
            payload, marks = pack_bits(np.frombuffer(batch.column("ids")[k].as_py(), f"<u{width}"), lengths, codes)
            row = batch.slice(k, 1).drop_columns(["ids"])
            yield row.append_column("payload", pa.array([payload.tobytes()], pa.binary())).append_column(
                "checkpoints", pa.array([marks.astype("<i8").tobytes()], pa.binary())
            )


def _counts(size: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        for x in batch.column("ids"):
            total += np.bincount(np.frombuffer(x.as_py(), f"<u{width}"), minlength=size)
    used = np.flatnonzero(total)
    yield pa.record_batch({"id": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = None,
) -> None:
    """Encode every text and write the ids in ascending order of ``id_col`` to the folder ``path``.

    Null and empty texts give no ids but ``end_id``, where one is given. Null document ids come first; rows
    with one id stay together in no fixed order. An empty table writes tables without rows.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    size = max(tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True), (end_id or 0) + 1)
    width = 2 if size <= 1 << 16 else 4
    ids = F.col("ids") if end_id is None else F.concat("ids", F.lit(end_id.to_bytes(width, "little")))
    texts = text_bytes(docs, text_col)
    coded = encode_documents(
        docs.select(id_col, text_col), tokenizer_path, id_col, text_col, bucket_number(docs, texts), decode=False, id_bytes=width
    )
    # Finding the ranges reads the ids of the documents from this table, and encodes nothing again.
    coded = stage(coded.select(F.col(id_col).alias("id"), ids.alias("ids")), "token-ids", compression="zstd")
    release(spark)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts // RANGE_BYTES)
    dealt = coded.repartitionByRange(ranges, "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
    head = [
        T.StructField("part", T.IntegerType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("first_token", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(id_type)),
        T.StructField("doc_tokens", T.ArrayType(T.LongType())),
    ]
    raw = stage(
        dealt.mapInArrow(lambda b: _segments(width, b), T.StructType([*head, T.StructField("ids", T.BinaryType())])), "segments", compression="zstd"
    )
    discard(coded)
    counted = raw.select("ids").mapInArrow(lambda b: _counts(size, width, b), "id int, n long").groupBy("id").agg(F.sum("n"))
    counts = np.zeros(size, np.int64)
    for number, n in counted.collect():  # a row per id of the vocabulary at most
        counts[number] = n
    lengths = code_lengths(counts)
    packed = raw.mapInArrow(
        lambda b: _encode(lengths, width, b),
        T.StructType([*head, T.StructField("payload", T.BinaryType()), T.StructField("checkpoints", T.BinaryType())]),
    )
    packed.write.parquet(f"{path}/segments")
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/lengths")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = raw.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per range partition
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.parquet(f"{path}/parts")
    discard(raw)


def _decode(lengths: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = decode_table(lengths)
    for batch in batches:
        for row in range(batch.num_rows):
            ids = unpack_bits(
                batch.column("payload")[row].as_py(),
                np.frombuffer(batch.column("checkpoints")[row].as_py(), "<i8"),
                batch.column("n_tokens")[row].as_py(),
                table,
            ).astype("<u4")
            docs, _ = list_parts(batch.column("doc_ids").slice(row, 1))
            n = np.asarray(list_parts(batch.column("doc_tokens").slice(row, 1))[0])
            bounds = np.concatenate([[0], np.cumsum(n)])
            first = batch.column("before")[row].as_py() + batch.column("first_token")[row].as_py()
            yield pa.record_batch(
                {
                    "id": docs,
                    "start": pa.array(first + bounds[:-1]),
                    "n_tokens": pa.array(n),
                    "ids": _binary(ids, bounds).cast(pa.binary()),
                }
            )


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of a folder: ``id_col``, ``start`` (tokens of all documents before), ``n_tokens``, ``ids``."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/lengths").first()[0], np.uint8)
    segments = spark.read.parquet(f"{path}/segments").join(
        F.broadcast(spark.read.parquet(f"{path}/parts")), "part"  # a row per range partition of the writer
    )
    id_type = segments.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    return segments.mapInArrow(lambda b: _decode(lengths, b), schema).withColumnRenamed("id", id_col)


def token_round_trip(
    docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the files to the shared folder and read them back (:func:`read_token_files`)."""
    path = f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path, id_col, text_col, end_id)
    return read_token_files(docs.sparkSession, path, id_col)


