"""Operators of search and mining on small hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from corpusweave.functions import scalars
from corpusweave.operators import chunking, context, corpus, graph, lexical, ranking
from corpusweave.operators.vectors import centroids, cosine, knn_join, normalised


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, n, expected",
    [("a" * 199 + "é", 200, "a" * 199 + "…"), ("a" * 198 + "日b", 200, "a" * 198 + "…"), ("  short ", 200, "short"), ("a" * 200, 200, "a" * 200)],
)
def test_byte_snippet(spark, text, n, expected):
    assert value(spark, scalars.byte_snippet(F.lit(text), n)) == expected


def test_scalars(spark):
    assert value(spark, scalars.slug(F.lit(" Hello, World! v2 "))) == "hello-world-v2"
    assert value(spark, scalars.slug(F.lit("!!"))) is None
    assert value(spark, scalars.approx_tokens(F.lit("é" * 6))) == 3
    assert value(spark, scalars.valid_url(F.lit(" https://a.b/c "))) and not value(spark, scalars.valid_url(F.lit("ftp://a.b")))
    assert value(spark, scalars.url_id(F.lit("http://a.b/x?q=1"))) != value(spark, scalars.url_id(F.lit("http://a.b/x?q=2")))
    assert value(spark, scalars.normal_title(F.lit("3.2  Slow   Method"))) == "slow method"
    assert value(spark, scalars.html_comments_out(F.lit("a<!-- x\ny -->b<!-- open"))) == "ab"
    assert value(spark, scalars.json_object(F.lit('so: {"a": 12} ok'), "a double"))["a"] == 12
    for text, found in (("2401.12345v2", ("2401.12345", "v2")), ("https://arxiv.org/abs/2401.1234", ("2401.1234", None)), ("cs/99", (None, None))):
        assert tuple(value(spark, c) for c in scalars.arxiv_id(F.lit(text))) == found


@pytest.mark.parametrize(
    "heading, section",
    [
        ("Results and Discussion", "experiments"),
        ("Introduction and Background", "introduction"),
        ("3.1 Proposed Method", "method"),
        ("Limitations", "limitations"),
        ("Acknowledgements", "other"),
    ],
)
def test_headings(spark, heading, section):
    assert value(spark, chunking.classify_heading(F.lit(heading))) == section


def test_packing(spark):
    pack = lambda text, budget: value(spark, chunking.pack_paragraphs(F.lit(text), budget))
    assert len(pack("\n\n".join(["x" * 400] * 3), 150)) == 3
    assert len(pack("\n\n".join(["x" * 100] * 4), 60)) == 2
    assert pack("x" * 2000, 100) == ["x" * 2000]
    assert pack("  \n ", 10) == []


def test_split_clean_and_build(spark):
    md = "pre\n# Intro {#a} ##\ntext\n```\n# not a heading\n```\n#### deep\nmore\n## Method\nbody"
    rows = chunking.split_at_headings(spark.createDataFrame([(1, md)], "doc_id long, text string")).orderBy("segment").collect()
    assert [(r.heading, r.body.count("\n")) for r in rows] == [(None, 0), ("Intro", 5), ("Method", 0)]
    dirty = "a\n<div>\n\n\n\n\\vspace \\begin{x}\n \\alpha \\beta\n```\n<div>\n\n\n```\n<div class=\"CCSXML\">x\ny"
    once = chunking.clean_markdown(spark.createDataFrame([(1, dirty)], "doc_id long, text string"))
    text = once.first().text
    assert text == "a\n\n \\alpha \\beta\n```\n<div>\n\n\n```\n"
    assert chunking.clean_markdown(once).first().text == text
    docs = spark.createDataFrame(
        [(1, "# Abstract\nold\n# Method\nm1\n# Approach\nm2", "abs", "# Notes\n<!-- x -->", None), (2, None, None, "# Notes\nmine", "deep")],
        "doc_id long, sections_md string, abstract string, notes_md string, reflection_md string",
    )
    got = {(r.doc_id, r.chunk_id, r.text) for r in chunking.build_chunks(docs).collect()}
    assert got == {(1, "1_abstract_0", "abs"), (1, "1_method_0", "m1"), (1, "1_method_1", "m2"), (2, "2_user_notes_0", "# Notes\nmine"), (2, "2_reflection_0", "deep")}


def test_outline_and_pages(spark):
    toc = spark.createDataFrame([(1, 0, "1 Introduction", 1), (1, 1, "3 Method", 3), (1, 2, "3.2 Slow Quantization", 4)], "doc_id long, pos int, title string, page int")
    heads = spark.createDataFrame([(1, 0, "Introduction"), (1, 1, "Quantization"), (1, 2, "Other"), (1, 3, "Method")], "doc_id long, place int, heading string")
    found = {r.place: r.page for r in chunking.match_outline(heads, toc).collect()}
    assert found == {0: 1, 1: 4, 3: 3}
    rows = spark.createDataFrame([(1, 0, "a", None), (1, 1, "a", 4), (1, 2, "user_notes", 9), (1, 3, "a", None)], "doc_id long, place int, section_type string, matched_page int")
    assert [r.page for r in chunking.fill_pages(rows).orderBy("place").collect()] == [1, 4, None, 4]


def test_vectors(spark):
    rows = [(i, i % 2, [float(i % 8 == j) + 0.05 * (i + 1) * ((i + 3) % 8 == j) for j in range(8)]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, side long, embedding array<float>")
    q = df.select(F.col("id").alias("q"), F.col("side").alias("qs"), "embedding")
    exact = (
        q.alias("a").join(df.alias("b"), F.col("a.qs") != F.col("b.side")).select("q", "id", F.round(cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cos"))
    )
    want = {}
    for r in sorted(exact.collect(), key=lambda r: (r.q, -r.cos, r.id)):
        want.setdefault(r.q, []).append((r.id, r.cos))
    for block in (3, 7, 4096):
        got = {}
        for r in knn_join(q, df, 4, "q", "id", "qs", "side", block=block).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append((r.id, r.cos))
        assert got == {k: v[:4] for k, v in want.items()}
    assert knn_join(q, df.filter("false"), 4, "q", "id").count() == 0
    assert knn_join(q, df, 99, "q", "id").filter("q = 0").count() == 20
    assert value(spark, normalised(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8] and value(spark, normalised(F.array(F.lit(0.0)))) == [0.0]
    assert value(spark, cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0
    centre = centroids(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None)], "d long, embedding array<double>"), "d").collect()
    assert len(centre) == 1 and abs(centre[0].embedding[0] - math.sqrt(0.5)) < 1e-9


def test_filters_and_recency(spark):
    rows = [(1, "abstract", "p1", ["nlp"], None, None), (2, "method", "p1", ["nlp"], "paper", None), (3, "method", "p2", ["vision"], "note", "global"), (4, "conclusion", "p3", [], "note", "kitgig")]
    df = spark.createDataFrame(rows, "vector_id long, section_type string, doc_id string, tags array<string>, kind string, project string")
    ids = lambda **k: [r.vector_id for r in ranking.filter_chunks(df, **k).orderBy("vector_id").collect()]
    assert ids() == [1, 2, 3, 4] and ids(sections=[]) == [] and ids(tags=["nlp", "vision"], sections=["method"]) == [2, 3]
    assert ids(kind="paper") == [1, 2] and ids(projects=["kitgig", "global"], kind="note") == [3, 4]
    now = F.lit("2024-07-01").cast("timestamp")
    at = lambda d: value(spark, ranking.recency(F.lit(d).cast("timestamp"), now))
    assert at("2024-07-01") == 1 and at("2030-01-01") == 1 and abs(at("2024-01-03") - 0.5) < 1e-9
    assert value(spark, ranking.recency(F.lit(None).cast("timestamp"), now)) == 0.5


def test_bm25(spark):
    df = spark.createDataFrame([(1, "online vector quantization for nearest neighbor search"), (2, "a paper about cats"), (3, "more dogs"), (4, "more birds")], "vector_id long, text string")
    q = spark.createDataFrame([(1, 'vector AND (search" OR *'), (2, "()")], "query_id long, query string")
    got = lexical.bm25(q, lexical.postings(df), 4, 4.0).collect()
    assert [(r.query_id, r.vector_id) for r in got] == [(1, 1)]


def test_pagerank(spark):
    edges = spark.createDataFrame([(0, 1, 2, 0.9), (0, 2, 3, 0.9), (0, 4, 5, 0.9), (0, 6, 6, 1.0), (0, 7, 8, 0.0)], "query_id long, src long, dst long, weight double")
    seeds = spark.createDataFrame([(0, 1, 1.0), (0, 9, 1.0)], "query_id long, node long, weight double")
    mass = {r.node: r.rank_mass for r in graph.pagerank(edges, seeds).collect()}
    assert set(mass) == {1, 2, 3, 4, 5} and mass[1] > mass[2] > mass[3] > mass[4] == 0


def test_graph(spark):
    links = spark.createDataFrame([(1, 2), (2, 2)], "src long, dst long")
    near = spark.createDataFrame([(2, 1, 0.4), (1, 3, 0.4), (3, 1, 0.6)], "src long, dst long, weight double")
    assert {tuple(r) for r in graph.undirected(links, near).collect()} == {(1, 2, "link", 1.0), (1, 3, "similar", 0.6)}
    pairs = spark.createDataFrame(
        [(5, 1, "method", [1], 2, 2, "limitations", [2], 0.7), (2, 2, "limitations", [2], 5, 1, "method", [1], 0.7), (8, 3, "other", [1], 9, 4, "other", [1], 0.9)],
        "x_id long, x_doc long, x_section string, x_categories array<int>, y_id long, y_doc long, y_section string, y_categories array<int>, cos double",
    )
    found = graph.surprise_edges(pairs, 0.5)
    assert {(r.src_chunk, r.dst_chunk, r.kind) for r in found.collect()} == {(2, 5, "need_solution"), (2, 5, "cross_domain")}
    assert graph.drop_incident(found, spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_connections_and_relevance(spark):
    hits = spark.createDataFrame([(1, 10, "a", 0.9, 1), (1, 10, "b", 0.8, 2), (1, 20, "a", 0.7, 3), (1, 10, "c", 0.6, 4), (1, 30, "a", 0.5, 5)], "query_id long, doc_id long, section_type string, cos double, rank int")
    got = {r.doc_id: (r.score, r.sections, r.place) for r in ranking.connection_strength(hits, 2).collect()}
    assert got == {10: (0.9, ["a", "b"], 1), 20: (0.7, ["a"], 2)}
    scored = spark.createDataFrame([(1, 1, 1.0, "note"), (1, 2, 1.0, "paper")], "query_id long, place long, score double, kind string")
    assert ranking.relevance(scored).first().score == 1.0
    assert ranking.relevance(scored.filter("place = 1").withColumn("score", F.lit(0.5))).first().score == 0.55


def test_upsert_and_cache(spark):
    old = spark.createDataFrame([("a", 0.1, "new"), ("b", 0.1, "dismissed")], "cand_id string, score double, status string")
    new = spark.createDataFrame([("a", 0.9), ("a", 0.8), ("b", 0.9), ("c", 0.3)], "cand_id string, score double")
    got = {r.cand_id: (r.score, r.status, r.inserted) for r in corpus.upsert_candidates(old, new).collect()}
    assert got == {"a": (0.9, "new", False), "b": (0.1, "dismissed", False), "c": (0.3, "new", True)}
    emb = corpus.hashed_embedding(spark.createDataFrame([("h", "x y x"), ("g", "")], "content_hash string, text string"), 8).collect()
    assert {r.content_hash: round(sum(x * x for x in r.embedding), 5) for r in emb} == {"h": 1.0, "g": 0.0}
    tags = corpus.edit_tags(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c")), F.array(F.lit("b")))
    assert value(spark, tags) == ["a", "c"]


def test_context(spark):
    nodes = spark.createDataFrame([(1, [], "user", "q", "ok", 1), (2, [1], "assistant", "a", "ok", 2), (3, [1], "assistant", "x", "error", 3), (4, [2, 3], "user", "z", "ok", 4)], "id long, parents array<long>, role string, text string, status string, created_at long")
    pairs = context.ancestors(nodes)
    assert {tuple(r) for r in pairs.collect()} == {(2, 1), (3, 1), (4, 2), (4, 3), (4, 1)}
    turns = {r.id: [t["text"] for t in r.turns] for r in context.history(nodes, pairs).collect()}
    assert turns[4] == ["q", "a"]
    replies = spark.createDataFrame([("x", 'I say {"clarity": 12, "depth": 4}'), ("x", '{"clarity": 1}')], "agent string, text string")
    assert context.scorecards(replies, ["clarity", "depth"]).first()[1:] == (10.0, 4.0)
    talk = spark.createDataFrame([(1, "p", 1, [1.0, 0.0]), (1, "p", 2, [1.0, 0.1])], "conv_id long, agent string, round int, embedding array<double>")
    assert context.convergence(talk, cosine).first().converged_at == 2


@pytest.mark.parametrize(
    "heading, section",
    [
        ("Limits and limitations of our method", "method"),
        ("Discussion", "conclusion"),
        ("Ablation", "other"),
        ("Threats to validity", "limitations"),
        ("Prior art", "background"),
        ("System design", "method"),
        ("Future directions", "future_work"),
    ],
)
def test_first_heading_rule_wins(spark, heading, section):
    assert value(spark, chunking.classify_heading(F.lit(heading))) == section


def test_indented_headings_and_nested_markup(spark):
    rows = chunking.split_at_headings(spark.createDataFrame([(1, "  ## A b {#x}\nt\n#tag\n###\nu")], "doc_id long, text string"))
    assert [(r.heading, r.body) for r in rows.orderBy("segment").collect()] == [("A b", "t\n#tag"), ("", "u")]
    md = "<a <b> c>\n<x> text\n< open\nkept par\nnoindent\n"
    assert chunking.clean_markdown(spark.createDataFrame([(1, md)], "doc_id long, text string")).first().text == "<x> text\n\nkept par\n\n"


def test_reading_windows(spark):
    md = "intro\n# A\n" + "a" * 30 + "\n# References\nx\n## B\n" + "b" * 30 + "\n\n" + "c" * 50 + "\n# C\nend\n"
    rows = chunking.reading_windows(spark.createDataFrame([(1, md), (2, " \n")], "doc_id long, text string"), budget_bytes=60)
    want = ["intro\n# A\n" + "a" * 30 + "\n", "## B\n" + "b" * 30, "c" * 50 + "\n", "# C\nend\n"]
    assert [r.text for r in rows.orderBy("doc_id", "window").collect()] == want


def test_events_and_ids(spark):
    from corpusweave.streaming.changes import document_events

    rows = [("/corpus/d1/idea.md", "upsert"), ("/corpus/d1/source/x.tex", "remove"), ("/corpus/d2", "remove"), ("/corpus/d3/reflection.md", "upsert"), ("/else/d4/notes.md", "upsert")]
    got = document_events(spark.createDataFrame([(p, o, 1) for p, o in rows], "path string, op string, ts long"), "/corpus")
    assert sorted((r.doc_id, r.op) for r in got.collect()) == [("d1", "remove"), ("d1", "upsert"), ("d2", "remove")]
    assert value(spark, scalars.arxiv_id(F.lit("https://arxiv.org/abs/2101.00001v3?x=1#y"))[1]) == "v3"


def test_listing(spark):
    docs = spark.createDataFrame(
        [("a", "Deep Nets", ["Ann Lee"], ["ml"], "2021"), ("b", "Graphs", ["Bo"], ["Neural"], "2022"), ("c", "Trees", [], None, "2020")],
        "doc_id string, title string, authors array<string>, tags array<string>, published_at string",
    )
    found = lambda x: [r.doc_id for r in corpus.find_documents(docs, x).collect()]
    assert (found("NE"), found("lee"), found("zz"), found(" ")) == (["b", "a"], ["a"], [], ["b", "a", "c"])
