"""Sources read from files, and streams against their batch twins."""

import json

from pyspark.sql import functions as F

from corpusweave.sources import files
from corpusweave.streaming import changes

FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">
<entry><id>http://arxiv.org/abs/2401.12345v2</id><title>A
  wrapped title</title><summary> S </summary><published>2024-01-01</published><author><name>A B</name></author><author><name>C</name></author>
<category term="cs.LG"/><category term="cs.CL"/></entry>
<entry><id>http://arxiv.org/abs/nonsense</id><title>x</title></entry></feed>"""


def test_sources(spark, tmp_path):
    for name, record in (("a", {"doc_id": "a", "title": "T"}), ("b", {"schema_version": 9}), ("n", {"doc_id": "n", "kind": "note"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(json.dumps(record))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "metadata.json").write_text("{broken")
    (tmp_path / "a" / "sections.md").write_text("# A\nbody")
    (tmp_path / "n" / "idea.md").write_text("idea")
    (tmp_path / "n" / "notes.md").write_text("notes")
    good, bad = files.read_metadata(spark, str(tmp_path))
    assert {r.doc_id: (r.kind, r.tags) for r in good.collect()} == {"a": ("paper", []), "n": ("note", [])}
    assert {r.folder for r in bad.collect()} == {"b", "c"}
    both = files.body_of_kind(good, files.read_bodies(spark, str(tmp_path)))
    assert {r.doc_id: (r.body, r.notes_md) for r in both.collect()} == {"a": ("# A\nbody", None), "n": ("idea", "notes")}
    (tmp_path / "feed.xml").write_text(FEED)
    entry = files.read_atom(spark, str(tmp_path / "feed.xml")).collect()
    assert [(r.doc_id, r.version, r.title, r.authors, r.categories) for r in entry] == [("2401.12345", "v2", "A wrapped title", ["A B", "C"], ["cs.LG", "cs.CL"])]
    (tmp_path / "urls.txt").write_text("# c\n\n http://a.b/c \nnot a url\n")
    assert {(r.url, r.valid) for r in files.read_urls(spark, str(tmp_path / "urls.txt")).collect()} == {("http://a.b/c", True), ("not a url", False)}


def test_articles_and_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://x", "<title>T &amp; U</title><nav>menu</nav><article><h1>H</h1><p>one<p>two <b>x</b></article>"), (2, "http://y", "<nav>only</nav>")], "page_id long, url string, html string"
    )
    good, failed = files.extract_articles(pages)
    assert good.first().title == "T & U" and good.first().markdown == "# H\n\none\n\ntwo x"
    assert failed.first().page_id == 2
    text = spark.createDataFrame([(1, 1, "long enough text for a page"), (1, 2, " ")], "doc_id long, page_no int, text string")
    other = spark.createDataFrame([(1, 2, "recovered")], "doc_id long, page_no int, text string")
    assert files.join_pages(text, other).first().body == "## Page 1\n\nlong enough text for a page\n\n## Page 2\n\nrecovered"


def test_change_stream(spark, tmp_path):
    rows = [("d1/sections.md", "upsert", 0), ("d1/notes.md", "upsert", 1), ("d2/notes.md", "upsert", 0), ("d2/x.md", "remove", 1), ("d1/a.pdf", "upsert", 2), (".git/notes.md", "upsert", 0), ("d1/notes.md", "upsert", 9), ("z/notes.md", "upsert", 4000)]
    df = spark.createDataFrame(rows, "path string, op string, s long").select("path", "op", F.timestamp_seconds("s").alias("ts"))
    batch = {(r.doc_id, r.n_events, r.op) for r in changes.debounce(changes.document_events(df)).collect()}
    assert batch == {("d1", 2, "upsert"), ("d1", 1, "upsert"), ("d2", 2, "remove"), ("z", 1, "upsert")}
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    seen = {"up": set(), "gone": set()}
    bursts = changes.debounce(changes.document_events(stream).withWatermark("ts", "10 seconds"))
    query = changes.synchronise(
        bursts, lambda x: seen["up"].update(r.doc_id for r in x.collect()), lambda x: seen["gone"].update(r.doc_id for r in x.collect()), str(tmp_path / "cp")
    )
    query.awaitTermination(120)
    assert seen["up"] >= {"d1"} and seen["gone"] == {"d2"}
