"""Incoming documents: scores and reasons, and feeds as a stream into the table of candidates."""

import os

from corpusweave.plans.incoming import score_incoming
from corpusweave.streaming import feeds


def embedder(texts):
    return [[float(t.count(c)) + 0.01 for c in "aei"] for t in texts]


CHUNKS = [(1, "p1", "method", [1.0, 0.0, 0.0]), (2, "p1", "abstract", [0.9, 0.1, 0.0]), (3, "n1", "other", [0.8, 0.0, 0.6]), (4, "p2", "method", [0.0, 0.0, 1.0])]


def tables(spark):
    chunks = spark.createDataFrame(CHUNKS, "vector_id long, doc_id string, section_type string, embedding array<double>")
    docs = spark.createDataFrame([("p1", "Paper", None), ("n1", None, "note"), ("p2", "Other", "paper"), ("2401.00009", "Known", "paper")], "doc_id string, title string, kind string")
    return chunks, docs


ENTRY = "doc_id string, title string, abstract string, authors array<string>, categories array<string>, published_at string"


def test_scores_and_reasons(spark):
    chunks, docs = tables(spark)
    rows = [("x", "aaaa", None), ("x2", "aaaa", None), ("y", "iii", "i"), ("y", "iii", "i"), ("2401.00009", "known", ""), (None, "aaaa", "")]
    entries = spark.createDataFrame([(*r, [], [], "2024") for r in rows], ENTRY)
    got = {r.doc_id: r for r in score_incoming(entries, chunks, docs, embedder, 3).collect()}
    assert set(got) == {"x", "x2", "y"} and got["x"].score == got["x2"].score
    why = got["x"].why
    assert [(c.doc_id, c.title, c.kind, c.sections) for c in why.connections] == [
        ("p1", "Paper", "paper", ["method", "abstract"]), ("n1", "n1", "note", ["other"]), ("p2", "Other", "paper", ["method"]),
    ] and why.connects_to_synthesis
    best = [c.score for c in why.connections]
    assert abs(got["x"].score - min(1.0, 0.7 * best[0] + 0.3 * sum(best) / 3 + 0.05)) < 1e-6
    nothing = score_incoming(entries, chunks.limit(0), docs, embedder, 3).collect()
    assert {r.score for r in nothing} == {0.0} and {r.why for r in nothing} == {None}
    assert score_incoming(entries.limit(0), chunks, docs, embedder, 3).count() == 0


def feed(*entries):
    return "<feed>" + "".join(f"<entry><id>http://arxiv.org/abs/{i}</id><title>{t}</title><summary>s</summary><published>2024</published></entry>" for i, t in entries) + "</feed>"


def test_feed_stream(spark, tmp_path):
    chunks, docs = tables(spark)
    box, table = tmp_path / "feeds", {"n": 0}
    box.mkdir()
    (box / "one.xml").write_text(feed(("2401.00001", "aaa"), ("2401.00002v2", "iii"), ("2401.00009", "known")))
    (box / "two.xml").write_text(feed(("2401.00002v2", "iii")))
    (box / "odd.xml").write_text("<html><p>not a feed</p></html>")
    (box / "readme.txt").write_text("no feed")
    schema = "cand_id string, title string, abstract string, authors array<string>, categories array<string>, published_at string, score double, why struct<connections:array<struct<doc_id:string,title:string,kind:string,score:double,sections:array<string>>>,connects_to_synthesis:boolean>, status string, first_seen_at string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "c0"))
    current = lambda: spark.read.schema(schema).parquet(str(tmp_path / f"c{table['n']}"))

    def accept(scored):
        feeds.refreshed_candidates(current(), scored).write.parquet(str(tmp_path / f"c{table['n'] + 1}"))
        table["n"] += 1

    def go():
        query = feeds.watch_feeds(spark, f"file://{box}", lambda e: score_incoming(e, chunks, docs, embedder, 3), accept, f"file://{tmp_path}/failed", f"file://{tmp_path}/checkpoint")
        query.awaitTermination(180)

    go()
    assert {(r.cand_id, r.title, r.status) for r in current().collect()} == {("2401.00001", "aaa", "new"), ("2401.00002", "iii", "new")}
    failed = spark.read.schema("file string, reason string").parquet(f"{tmp_path}/failed").collect()
    assert [(os.path.basename(r.file), r.reason) for r in failed] == [("odd.xml", "no entry")]
    (box / "three.xml").write_text(feed(("2401.00001", "eee"), ("2401.00003", "a")))
    before = {r.cand_id: r.score for r in current().collect()}
    go()
    after = {r.cand_id: r for r in current().collect()}
    assert set(after) == {"2401.00001", "2401.00002", "2401.00003"} and after["2401.00001"].title == "eee" and after["2401.00001"].score != before["2401.00001"]
    go()
    assert table["n"] == 2  # nothing new
