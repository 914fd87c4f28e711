"""Packing, the fill-in-middle transformation and clustering against brute force, with odd rows."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.llm import clustering, fill_middle, packing
from corpusweave.llm.queries import vocabulary_path

ODD = [
    None, "", " ", "\n", "\n\n", "a\n", "a\nb", "it's DON'T 'sun x''s \"'tis a'b", "<|endoftext|>a<|ENDOFTEXT|> b<|startoftext|>H̱ T̈é É",
    "日本語 12½ 3,4.5 \x0b\x0c a b c \x1cd\x00e", "A<b|c>d<P>\n<", "ＡΣΑΣ ﬁ ǅ", "don’t “x”—y…9'9 9's", ",́a ́b", "<S\n<M\n>\n<P", "x" * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, "\n"), (3, "\n")]
    for k in range(150):
        words = ["".join(rng.choice("abcdéß'.-7") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(120))]
        rows.append((100 + k, "".join(w + rng.choice([" ", "\n", "  ", "\n\n"]) for w in words)))
    rows.append((999, "long line " * 3000 + "\n" + "é\n" * 4000))
    named = {c: F.lit(1) for c in ("part", "ids", "start", "n", "frames", "form", "output", "id")}
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns(named).cache()


def encoded(path, end_id):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda t: own.encode(t or "", add_special_tokens=False).ids + ([] if end_id is None else [end_id])


@pytest.mark.parametrize("name, end_id, size", [("word_bpe_49k.json", 2, 4096), ("word_bpe_49k.json", None, 16), ("byte_bpe_50k.json", 2, 61)])
def test_packing(docs, name, end_id, size):
    path = vocabulary_path(name)
    encode = encoded(path, end_id)
    packed = packing.pack_documents(docs, path, end_id=end_id, size=size).cache()
    rows = sorted(packed.collect(), key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in rows] == list(range(len(rows)))
    assert all(r.n_tokens == size for r in rows[:-1]) and 0 < rows[-1].n_tokens <= size
    found = []
    for r in rows:
        at = 0
        for p in r.pieces:
            assert p.offset == at
            at += p.length
            found.append((p.id, p.start, p.doc_tokens, r.ids[4 * p.offset : 4 * at]))
        assert at == r.n_tokens and len(r.ids) == 4 * at
    texts, doc, got = sorted(((r.doc_id is None, r.doc_id or 0, encode(r.text)) for r in docs.collect())), b"", []
    for key, start, total, ids in found:  # pieces of a document follow each other
        assert len(doc) == 4 * start
        doc += ids
        if len(doc) == 4 * total:
            got.append((key is None, key or 0, list(struct.unpack(f"<{total}I", doc))))
            doc = b""
    assert sorted(got) == [t for t in texts if t[2]]
    table = packing.piece_table(packed).collect()
    assert sorted((r.sequence_id, r.offset, r.length, r.ids_crc32) for r in table) == sorted(
        (r.sequence_id, p.offset, p.length, zlib.crc32(r.ids[4 * p.offset : 4 * (p.offset + p.length)])) for r in rows for p in r.pieces
    )


def test_padding_and_no_rows(spark, docs):
    path = vocabulary_path("word_bpe_49k.json")
    text = lambda n: spark.createDataFrame([(1, "a " * n)], "doc_id long, text string")
    for n, filled in ((20, 32), (24, 32), (31, 32), (32, 32), (15, 16), (3, 4)):
        last = packing.pack_documents(text(n), path, end_id=2, size=32, pad_id=7).orderBy("sequence_id").collect()[-1]
        left = (n + 1) % 32 or 32
        width = left if left & (left - 1) == 0 else 32
        assert last.n_tokens == left and len(last.ids) == 4 * width
        assert struct.unpack(f"<{width}I", last.ids)[left:] == (7,) * (width - left)
    empty = docs.limit(0)
    assert packing.pack_documents(empty, path, end_id=2).count() == 0


def in_fill(i, t, seed, rate, spm):
    t = t or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n, said = len(units), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(said[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, t
    spm = h[3] % 100 < spm
    return i, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame_bytes, rate, spm", [(1 << 17, 100, 50), (7, 100, 50), (64, 60, 0)])
def test_fill_in_middle(docs, frame_bytes, rate, spm):
    store = fill_middle.frame_store(docs, frame_bytes=frame_bytes)
    out = fill_middle.fill_in_middle(store, 7, rate, spm).cache()
    want = [in_fill(r.doc_id, r.text, 7, rate, spm) for r in docs.collect()]
    got = [tuple(r) for r in fill_middle.texts(out).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    both = sorted((repr(r.doc_id), r.output_sha256, r.restored_sha256) for r in fill_middle.digests(out).collect())
    texts = {(r.doc_id, in_fill(r.doc_id, r.text, 7, rate, spm)[5]): r.text for r in docs.collect()}
    assert both == sorted((repr(w[0]), sha(w[5]), sha(texts[w[0], w[5]])) for w in want)
    assert fill_middle.digests(fill_middle.fill_in_middle(fill_middle.frame_store(docs.limit(0)), 7)).count() == 0


def test_only_cut_frames_are_opened():
    text = "".join(f"line {k}\n" for k in range(20_000)).encode()
    packer, _ = fill_middle._codec()
    x = fill_middle._stored(text, 1000, packer)
    assert len(x["frames"]) > 100 and x["n"] == 20_000 and x["units"][-1] == 20_000
    reader = fill_middle._Reader(x["frames"], x["units"], x["chars"], x["n"])
    out, before, between = fill_middle._transformed(reader, "psm", (5000, 15_003))
    assert reader.opened <= 4  # to find both cuts, and to part those frames
    lines = text.decode().splitlines(keepends=True)
    p, m, s = ("".join(lines[a:b]) for a, b in ((0, 5000), (5000, 15_003), (15_003, None)))
    assert (before, between) == (len(p), len(m))
    assert b"".join(fill_middle.stream(out)).decode() == f"<P>{p}<S>{s}<M>{m}"
    assert b"".join(fill_middle.restored(out, "psm")) == text


def lloyd(rows, k, rounds, seed):
    """Plain rounds over all pairs: rows of (id, whole vector)."""
    said = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (said(r[0]), r[1]))
    x = np.array([v for _, v in rows], np.int64)
    c = x[:k]
    for at in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if at < rounds:
            c = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    best = d[np.arange(len(x)), own]
    sha = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted(
        ((i, int(own[n]), int(best[n]), int(best[own == own[n]].sum()), int(best.sum()), sha[own[n]]) for n, (i, _) in enumerate(rows)), key=repr
    )


@pytest.mark.parametrize("size, k, spread", [(4, 5, 0.03), (8, 16, 0.5), (3, 4, 30_000.0), (2, 50, 0.2)])
def test_clusters(spark, size, k, spread):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, size)) * spread * 3
    rows = [(n, [float(y) for y in centre[n % 6] + rng.normal(size=size) * spread]) for n in range(40 if k == 50 else 400)]
    rows += [(n, rows[n][1]) for n in range(10)] + [(5000 + n, rows[0][1]) for n in range(20)] + [(None, rows[1][1])]  # repeats and ties
    bad = [(7000, None), (7001, []), (7002, [0.5] * (size + 1)), (7003, [None] + [0.5] * (size - 1)), (7004, [float("nan")] * size), (7005, [float("-inf")] * size)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(4)
    table = table.withColumn("v", F.lit("x")).withColumn("cluster", F.lit("x")).withColumn("id", F.lit(0))
    vectors = clustering.integer_vectors(table, size)
    got = clustering.centroid_clusters(vectors, k, 3, 1).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    whole = [(i, [int(np.floor(64 * y)) for y in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd(whole, k, 3, 1)


def test_clusters_of_no_rows_and_large_components(spark):
    table = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    none = clustering.centroid_clusters(clustering.integer_vectors(table.limit(0), 2), 3, 2, 1)
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="too large"):
        clustering.integer_vectors(table, 2).collect()


def test_bounds_spare_work_and_lose_nothing():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(2000, 8)) * 20 + rng.integers(0, 4, (2000, 1)) * 400).astype(np.int64)
    history = [x[:12].copy()]
    d = clustering._squared(x, history[0])
    assert (d == ((x[:, None] - history[0][None]) ** 2).sum(2)).all()
    own, dist, seen, spared = d.argmin(1), np.sqrt(d), np.zeros(d.shape, np.int16), 0
    for _ in range(8):
        history.append(np.array([x[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else history[-1][j] for j in range(12)]))
        best, square, looks = clustering.nearest(np.array(history), x, own, dist, seen, True)
        d = ((x[:, None] - history[-1][None]) ** 2).sum(2)
        assert (best == d.argmin(1)).all() and (square == d.min(1)).all()
        own, spared = best, spared + x.shape[0] * 12 - looks.sum()
    assert spared > 0.5 * 8 * 2000 * 12
