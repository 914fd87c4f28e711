"""Quantised search, modes and pools, listings and the brief."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import brief, quantised
from corpusweave.operators.vectors import knn_join
from corpusweave.plans import modes


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_quantised_search_is_exact(spark, bits):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(12, 9))
    rows = [(i, i % 30, [float(x) for x in middle[i % 12] + 0.3 * rng.normal(size=9)]) for i in range(700)]
    rows += [(1000 + i, 99, rows[5][2]) for i in range(60)] + [(2000, 1, [0.0] * 9), (2001, 1, [2.5] * 9), (2002, 2, None)]
    both = spark.createDataFrame(rows, "id long, doc int, embedding array<double>").repartition(3).cache()
    left, right = both.filter("id % 7 = 0 or id > 1990").select(F.col("id").alias("l"), "doc", "embedding"), both.select(F.col("id").alias("r"), "doc", "embedding")
    want = {(r.l, r.r): r.cos for r in knn_join(left, right, 8, "l", "r", "doc", "doc").collect()}
    got = {(r.l, r.r): r.cos for r in quantised.quantised_join(left, right, 8, "l", "r", "doc", "doc", bits=bits).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    codes = quantised.quantised_table(right, "r", "doc", bits=bits)
    assert {len(r.codes) for r in codes.collect()} == {-(-9 * bits // 8)}
    pairs = quantised.quantised_candidates(left, codes, 8, "l", "doc", bits=bits).count()
    share = pairs / (left.count() * right.count())
    assert len(want) / (left.count() * right.count()) <= share < {2: 1.0, 4: 0.35, 8: 0.2}[bits]
    assert quantised.quantised_join(left.limit(0), right, 3, "l", "r").count() == 0 and quantised.quantised_join(left, right.limit(0), 3, "l", "r").count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        quantised.quantised_join(spark.createDataFrame([(1, [1.0])], "l long, embedding array<double>"), right, 3, "l", "r")
    with pytest.raises(ValueError, match="bits"):
        quantised.quantised_table(right, "r", bits=3)


def test_pools_and_limits():
    assert [modes.pool(x, k) for x, k in (("search", 10), ("connections", 8), ("similar", 8), ("similar", 50), ("graph", 3), ("edges", 6), ("edges", 90), ("solutions", 5), ("solutions", 1))] == [40, 32, 108, 300, 48, 28, 200, 48, 20]
    assert [modes.clamped(x, k) for x, k in (("search", None), ("search", 0), ("search", 500), ("problems", None), ("problems", 99), ("graph", -1), ("sparks", 9999), ("brief", 0))] == [10, 1, 100, 8, 30, 0, 500, 1]
    assert modes.given([]) is None and modes.given(["a"]) == ["a"] and modes.known_sections(["method"]) == ["method"] and modes.known_sections(None) is None
    with pytest.raises(ValueError, match="results"):
        modes.known_sections(["method", "results"])


def test_modes_of_each_query(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "method", None, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    chunks = spark.createDataFrame(rows, "vector_id long, section_type string, embedded_at timestamp, embedding array<double>")
    asked = [(1, "narrow", None), (2, "wide", None), (3, None, 3), (4, "wide", 500), (5, "narrow", 0)]
    queries = spark.createDataFrame([(q, m, k, rows[q][3]) for q, m, k in asked], "query_id long, mode string, k int, embedding array<double>")
    as_of = F.lit("2024-01-31").cast("timestamp")
    found = modes.mode_search(queries, chunks, as_of).collect()
    counts = {q: sum(r.query_id == q for r in found) for q, *_ in asked}
    assert counts == {1: 10, 2: 40, 3: 3, 4: 100, 5: 1}
    assert min(r.cos for r in found if r.query_id in (1, 3, 5)) >= 0.3
    with pytest.raises(Exception, match="no mode broad"):
        modes.mode_search(queries.withColumn("mode", F.lit("broad")), chunks, as_of).collect()
    assert modes.mode_search(queries.limit(0), chunks, as_of).count() == 0


EDGES = "src_chunk long, dst_chunk long, src_doc string, kind string, similarity double, surprise double"


def test_sparks_with_titles(spark):
    edges = spark.createDataFrame(
        [(1, 2, "?", "need_solution", 0.9, 0.9), (2, 3, "?", "cross_domain", 0.8, 0.95), (1, 99, "?", "cross_domain", 1.0, 1.0), (1, 3, "?", "need_solution", 0.9, 0.9)], EDGES
    )
    chunks = spark.createDataFrame([(1, "a", "limitations", "s1"), (2, "b", "method", "s2"), (3, "c", "method", "s3")], "vector_id long, doc_id string, section_type string, snippet string")
    docs = spark.createDataFrame([("a", "Title A"), ("a", "Title A"), ("b", "")], "doc_id string, title string")
    got = brief.list_sparks(edges, chunks, docs).orderBy(F.desc("surprise"), "src_chunk", "dst_chunk").collect()
    assert [(r.src_title, r.dst_title, r.directed, r.dst_snippet) for r in got] == [("b", "c", False, "s3"), ("Title A", "b", True, "s2"), ("Title A", "c", True, "s3")]
    assert [r.kind for r in brief.list_sparks(edges, chunks, docs, 1, "all").collect()] == ["cross_domain"]  # the dangling edge takes no place
    assert brief.list_sparks(edges, chunks, docs, kind="need_solution").count() == 2
    with pytest.raises(ValueError, match="no kind"):
        brief.kind_filter("odd")


def test_brief_surfaces_another_document_each_time(spark, tmp_path):
    docs = spark.createDataFrame(
        [("p", "paper", "P", "x"), ("n1", "note", "", " " + "é" * 300), ("r1", "reflection", "R", "short "), ("r2", "reflection", None, None)], "doc_id string, kind string, title string, body string"
    )
    cands = spark.createDataFrame(
        [("c1", 0.5, "2024-01-02", "new"), ("c2", 0.9, None, "new"), ("c3", 0.9, "2024-01-01", "new"), ("c4", 1.0, "2024-01-01", "dismissed")],
        "cand_id string, score double, published_at string, status string",
    )
    sparks = spark.createDataFrame([(k, k + 1, "x", "cross_domain", 0.5, k / 10) for k in range(8)], EDGES)
    watches = spark.createDataFrame([(1,), (2,)], "watch_id long")
    cursor = spark.createDataFrame([("r1", "2024-01-05"), ("gone", "2020-01-01")], "doc_id string, shown_at string")
    seen = []
    for day in range(4):
        row, after = brief.brief(cands, sparks, docs, watches, cursor, F.lit(f"2024-02-0{day + 1}"), 2)
        r = row.collect()
        assert len(r) == 1
        seen.append((r[0].resurfaced.doc_id, r[0].resurfaced.title))
        if day == 0:
            assert [x.cand_id for x in r[0].new_documents] == ["c3", "c2"] and [x.src_chunk for x in r[0].sparks] == [7, 6, 5, 4, 3]
            assert r[0].stats.asDict() == {"documents": 4, "new_candidates": 3, "watches": 2} and r[0].resurfaced.snippet == "é" * 280 + "…"
        after.write.parquet(str(tmp_path / str(day)))
        cursor = spark.read.parquet(str(tmp_path / str(day)))
    assert seen == [("n1", "n1"), ("r2", "r2"), ("r1", "R"), ("n1", "n1")]
    row, after = brief.brief(cands.limit(0), sparks.limit(0), docs.filter("kind = 'paper'"), watches, cursor, F.lit("x"))
    empty = row.first()
    assert empty.resurfaced is None and empty.new_documents == [] and empty.sparks == [] and after.count() == cursor.count()
    assert {(r.status, r.n) for r in brief.status_counts(cands).collect()} == {("new", 3), ("dismissed", 1)}
