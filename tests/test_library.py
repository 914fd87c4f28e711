"""The user's side of a corpus."""

import json

from pyspark.sql import functions as F

from corpusweave.operators import library


def ids(rows, key="doc_id"):
    return [r[key] for r in rows.collect()]


def test_look_ups(spark):
    chunks = spark.createDataFrame([(3, "a_2", "a"), (1, "a_0", "a"), (2, "b_0", "b")], "vector_id long, chunk_id string, doc_id string")
    assert ids(library.chunks_by_id(chunks, spark.createDataFrame([("b_0",), ("b_0",), ("zz",)], "chunk_id string")), "vector_id") == [2]
    assert ids(library.chunks_of_documents(chunks, spark.createDataFrame([("a",), ("c",)], "doc_id string")), "vector_id") == [1, 3]
    ranked = spark.createDataFrame([(2, 2), (9, 1), (3, 3)], "vector_id long, rank int")
    assert [(r.vector_id, r["rank"]) for r in library.hydrated(ranked, chunks).collect()] == [(2, 2), (3, 3)]
    docs = spark.createDataFrame([("b", "note"), ("a", None), ("c", "paper")], "doc_id string, kind string")
    assert ids(library.documents_of_kind(docs, "paper")) == ["a", "c"] and ids(library.documents_of_kind(docs, "reflection")) == []


def test_notes_and_bookmarks(spark):
    docs = spark.createDataFrame(
        [("n1", "note", "N", None, "2024-01-01", "  " + "é" * 300), ("n2", "note", "M", "p", "2024-03-01", None), ("n3", "note", "O", "p", None, "x"), ("d", "paper", "D", None, "2025", "x")],
        "doc_id string, kind string, title string, project string, updated_at string, body string",
    )
    got = library.list_notes(docs).collect()
    assert [(r.doc_id, r.project, r.preview) for r in got] == [("n2", "p", ""), ("n1", "global", "é" * 200), ("n3", "p", "x")]
    marks = spark.createDataFrame([("n1", "1"), ("gone", "3"), ("d", "2")], "doc_id string, created_at string")
    again = library.insert_or_ignore(marks, spark.createDataFrame([("n1", "9"), ("n2", "5"), ("n2", "4")], "doc_id string, created_at string"), ["doc_id"])
    assert {tuple(r) for r in again.collect()} == {("n1", "1"), ("gone", "3"), ("d", "2"), ("n2", "4")}
    assert ids(library.list_bookmarks(again, docs)) == ["n2", "d", "n1"]
    noted = spark.createDataFrame([("a", "old", 1), ("b", None, 2), ("c", "keep", 3)], "doc_id string, notes_md string, other int")
    notes = spark.createDataFrame([("a", "second", "t2"), ("a", "first", "t1"), ("b", "only", "t1"), ("zz", "lost", "t1"), ("c", None, "t1")], "doc_id string, note string, at string")
    text = {r.doc_id: r.notes_md for r in library.append_notes(noted, notes).collect()}
    block = lambda at, x: f"\n---\n_{at} (added via HTTP)_\n\n{x}\n"
    assert text == {"a": "old" + block("t1", "first") + block("t2", "second"), "b": block("t1", "only"), "c": "keep"}


def test_flags_and_refetching(spark):
    watches = spark.createDataFrame([(1, True, None), (2, True, "x")], "watch_id long, enabled boolean, last_refreshed_at string")
    off = library.set_column(watches, spark.createDataFrame([(2,), (7,), (2,)], "watch_id long"), "watch_id", "enabled", F.lit(False))
    assert {tuple(r) for r in off.collect()} == {(1, True, None), (2, False, "x")}
    old = spark.createDataFrame([("a", ["mine"]), ("b", None)], "doc_id string, tags array<string>")
    fresh = spark.createDataFrame([("a", ["cs"], "T"), ("b", ["cs"], "U"), ("c", [], "V")], "doc_id string, tags array<string>, title string")
    assert {r.doc_id: r.tags for r in library.refetched(old, fresh).collect()} == {"a": ["mine"], "b": ["cs"], "c": []}


def test_graph_and_turns(spark):
    edges = spark.createDataFrame([(1, 2, "similar", 0.9), (2, 1, "similar", 0.95), (1, 3, "link", 1.0), (4, 1, "similar", 0.4), (2, 2, "link", 1.0), (5, 6, "link", 1.0)], "a long, b long, kind string, weight double")
    got = library.neighbours(edges, spark.createDataFrame([(1,), (1,), (9,)], "node long")).orderBy("place").collect()
    assert [(r.neighbour, r.strength) for r in got] == [(3, 101.0), (2, 0.95), (4, 0.4)]
    nodes = spark.createDataFrame([(1, []), (2, [1]), (3, [1, 2, 1]), (4, None)], "id long, parents array<long>")
    of = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted((r.parent, r.id) for r in library.children(nodes, of).collect()) == [(1, 2), (1, 3), (2, 3)]
    outline = spark.createDataFrame([("a", "z", 2), ("a", "b", 2), ("a", "c", 1)], "doc_id string, title string, page int")
    assert ids(library.list_outline(outline), "title") == ["c", "b", "z"]


def test_checks(spark):
    for n in (0, 1, 7, 10, 25, 1003):
        chunks = spark.range(n).select((F.col("id") * 3).alias("vector_id")).repartition(3)
        step = max(1, n // 10)
        assert sorted(ids(library.check_ids(chunks), "vector_id")) == [3 * k for k in range(n)][::step][:10]
    indexed = chunks.filter("vector_id <> 0")
    assert library.verify(chunks, indexed).first().asDict() == {"n_chunks": 1003, "n_indexed": 1002, "checked": 10, "missing": 1, "ok": False}
    assert library.verify(chunks, chunks, deep=True).first().asDict() == {"n_chunks": 1003, "n_indexed": 1003, "checked": 1003, "missing": 0, "ok": True}


def test_names_and_json(spark):
    rows = spark.createDataFrame([("Reflection: on x", None), ("A thought", None), ("b", "own"), ("—", None)], "title string, slug string")
    got = rows.select(library.reflection_id(F.col("title"), F.col("slug")).alias("i"))
    assert ids(got, "i") == ["reflection-on-x", "reflection-a-thought", "own", None]
    nested = spark.createDataFrame([(1, None)], "a int, b string").withColumn("c", F.array(F.struct(F.lit(1).alias("x"))))
    assert json.loads(library.as_json(nested).first()["json"]) == {"a": 1, "b": None, "c": [{"x": 1}]}
