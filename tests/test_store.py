"""Embedding with a cache, and the corpus store: replacing, removing, rebuilding, guards and repetition after failures."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from corpusweave.operators import graph
from corpusweave.plans.embedding import CACHE_SCHEMA, embed_with_cache, ingest_report
from corpusweave.plans.store import SCHEMAS, Config, Store

DIM = 6
DOC = (
    "doc_id string, kind string, project string, title string, categories array<string>, links array<string>, published_at string, tags array<string>,"
    " abstract string, notes_md string, body string, outline array<struct<title:string,page:int>>"
)


def embedder(log, wrong=None):
    """Vectors by letters; every text that it is given goes into the log."""

    def run(texts):
        with open(log, "a") as out:
            out.writelines(f"{len(t)}\n" for t in texts)
        found = [[float(t.count(c) + 1) for c in "aeiout"] for t in texts]
        return found[1:] if wrong == "count" else [v[1:] for v in found] if wrong == "length" else [[float("nan")] * DIM for _ in texts] if wrong == "nan" else found

    return run


def calls(log):
    return sum(1 for _ in open(log)) if os.path.exists(log) else 0


def document(k, body=None):
    body = body or f"# Method {k}\n\n" + f"aeiou {'a' * k} {'e' * (k % 5)} tt" + f"\n\n# Limitations\n\nuuu {'o' * (k % 7)} {k}\n"
    return (f"d{k}", "paper", None, f"T{k}", [f"c{k % 4}"], [], "2024", ["x", f"t{k % 3}", "x"], f"abstract {k % 3}", None, body, [("Method", 1), ("Limitations", 2 + k)])


def test_embedding_with_a_cache(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [(1, "a text"), (1, "another"), (2, "a text"), (3, ""), (3, "last")]
    chunks = spark.createDataFrame(rows, "doc_id long, text string").withColumn("content_hash", F.sha2("text", 256))
    cache = spark.createDataFrame([], CACHE_SCHEMA)
    embedded, fresh = embed_with_cache(chunks, cache, embedder(log), "m", 1, DIM, batch=2)
    assert embedded.count() == 5 and fresh.count() == 4 and calls(log) == 4
    assert {len(r.embedding) for r in embedded.collect()} == {DIM}
    again, more = embed_with_cache(chunks, fresh, embedder(log), "m", 1, DIM)
    assert again.count() == 5 and more.count() == 0 and calls(log) == 4
    assert {(r.doc_id, r.n_chunks, r.cache_hits) for r in ingest_report(again).collect()} == {(1, 2, 2), (2, 1, 1), (3, 2, 2)}
    assert embed_with_cache(chunks, fresh, embedder(log), "other", 1, DIM)[1].count() == 4 and calls(log) == 8  # another model's vectors don't count
    for wrong, said in (("count", "vectors for"), ("length", "dimensions"), ("nan", "finite")):
        with pytest.raises(Exception, match=said):
            embed_with_cache(chunks, cache, embedder(log, wrong), "m", 1, DIM)
    assert embed_with_cache(chunks.limit(0), cache, embedder(log), "m", 1, DIM)[0].count() == 0


def snapshot(root, version):
    return {p: os.stat(p).st_ino for p in glob.glob(f"{root}/derived/v={version}/*/bucket=*/*.parquet")}


def rows_of(store, name):
    return sorted((tuple(r) for r in store.table(name).drop("embedding").collect()), key=repr)


@pytest.fixture()
def store(spark, tmp_path):
    root = f"{tmp_path}/store"
    own = Store(spark, f"file://{root}", Config("m", DIM, min_similarity=0.9), buckets=16)
    docs = spark.createDataFrame([document(k) for k in range(12)], DOC)
    assert own.version() == 0
    with pytest.raises(ValueError, match="nothing is built"):
        own.table("chunks")
    assert own.rebuild(docs, embedder(str(tmp_path / "log"))) == 1
    return own


def test_replace_one_document(spark, store, tmp_path, monkeypatch):
    root, log = f"{tmp_path}/store", str(tmp_path / "log")
    before, edges, asked = snapshot(root, 1), rows_of(store, "edges"), calls(log)
    assert edges and len(rows_of(store, "tags")) == 24 and len(rows_of(store, "chunks")) == 36
    assert {r.page for r in store.table("chunks").filter("doc_id = 'd5' and section_type = 'limitations'").collect()} == {7}
    new = spark.createDataFrame([document(3, "# Method\n\nall new aaaa\n\n# Future Work\n\nmore ttt\n")], DOC)
    # It fails between two tables; the same call then completes it.
    whole = Store._overwrite
    monkeypatch.setattr(Store, "_overwrite", lambda self, name, *a: (_ for _ in ()).throw(OSError("lost")) if name == "tags" else whole(self, name, *a))
    with pytest.raises(OSError):
        store.replace_documents(new, embedder(log))
    monkeypatch.setattr(Store, "_overwrite", whole)
    store.replace_documents(new, embedder(log))
    after, mine = snapshot(root, 1), store._touched(new)
    in_bucket = lambda p: int(p.split("bucket=")[1].split("/")[0])
    for name in ("documents", "chunks", "tags", "outline"):
        other = {p: x for p, x in before.items() if f"/{name}/" in p and in_bucket(p) not in mine}
        assert other and all(after.get(p) == x for p, x in other.items())
    own = store.table("chunks").filter("doc_id = 'd3'")
    assert {r.section_type for r in own.collect()} == {"abstract", "method", "future_work"}
    assert calls(log) == asked + 2  # the abstract was known
    assert {(r.title, r.page) for r in store.table("outline").filter("doc_id = 'd3'").collect()} == {("Method", 1), ("Limitations", 5)}
    # Edges: those of other documents as they were, those of this one as its chunks find them.
    ids = spark.createDataFrame([("d3",)], "doc_id string")
    chunks = store.table("chunks").join(store.table("documents").select("doc_id", "categories"), "doc_id")
    found = graph.surprise_edges(graph.edge_pairs(chunks, 6, ids), 0.9)
    kept = [e for e in edges if "d3" not in (e[2], e[3])]
    assert rows_of(store, "edges") == sorted(set(kept) | {tuple(r) for r in found.collect()}, key=repr)


def test_remove_wipes_all_traces(spark, store):
    ids = spark.createDataFrame([("d3",), ("d4",), ("unknown",), (None,)], "doc_id string")
    store.remove_documents(ids)
    for name in SCHEMAS:
        text = repr(rows_of(store, name))
        assert "'d3'" not in text and "'d4'" not in text and "'d5'" in text
    store.remove_documents(ids)  # nothing is left to do
    store.remove_documents(store.table("documents").select("doc_id"))
    assert all(rows_of(store, name) == [] for name in SCHEMAS)


def test_rebuild_shows_at_once_and_reports(spark, store, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    before, asked = {name: rows_of(store, name) for name in SCHEMAS}, calls(log)
    docs = spark.createDataFrame([document(k) for k in range(12)] + [document(2, "other body")], DOC)
    odd = spark.createDataFrame([(None, *document(1)[1:]), ("blank", *document(1)[1:8], None, None, " ", [])], DOC)
    monkeypatch.setattr(Store, "_pairs", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.rebuild(docs, embedder(log))
    assert store.version() == 1 and {name: rows_of(store, name) for name in SCHEMAS} == before
    monkeypatch.undo()
    broken = spark.createDataFrame([("b", "metadata unreadable")], "doc_id string, reason string")
    version = store.rebuild(docs.filter("body <> 'other body'").union(odd).union(docs.filter("doc_id = 'd2'")), embedder(log), broken)
    assert store.version() == version == 3
    want = {(None, "no id"), ("blank", "no text"), ("d2", "id given more than once"), ("b", "metadata unreadable")}
    assert {tuple(r) for r in store.table("report").collect()} == want
    assert rows_of(store, "chunks")[:3] == before["chunks"][:3] and calls(log) - asked <= 1  # cached texts aren't embedded again
    assert not glob.glob(f"{tmp_path}/store/derived/v=1/chunks")  # one version before it stays: the one that failed


def test_guards_and_garbage(spark, store):
    root = store.root
    with pytest.raises(ValueError, match="rebuild"):
        Store(spark, root, Config("other", DIM), 16).table("chunks")
    with pytest.raises(ValueError, match="rebuild"):
        Store(spark, root, Config("m", DIM + 1), 16).check()
    with pytest.raises(ValueError, match="buckets"):
        Store(spark, root, Config("m", DIM), 8).check()
    with pytest.warns(UserWarning, match="until the next rebuild"):
        assert Store(spark, root, Config("m", DIM, chunk_tokens=7), 16).table("chunks").count() == 36
    known = store.cache().count()
    store.collect_garbage(store.table("documents").filter("doc_id <> 'd0'"))
    assert store.table("documents").count() == 11 and store.cache().count() < known
    assert store.cache().join(store.table("chunks"), "content_hash", "left_anti").count() == 0
