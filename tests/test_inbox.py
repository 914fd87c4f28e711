"""The inbox: good, bad and unknown files, twice over one checkpoint, and documents that came while nothing ran."""

import json
import os

from corpusweave.streaming import inbox


def test_inbox(spark, tmp_path):
    box, seen = tmp_path / "inbox", {}
    box.mkdir()
    html = "<title>T</title><article><h1>H</h1><p>Some text.</p></article>"
    fetched = spark.createDataFrame([("http://a.b/c", html), ("http://a.b/c", html), ("http://a.b/empty", "<nav>x</nav>")], "url string, html string")
    files = {
        "good.txt": "# list\n\n http://a.b/c \nhttp://a.b/c\n",
        "half.url": "http://a.b/c\nhttp://not.there/x\n",
        "words.txt": "no url at all\n",
        "blank.txt": "# only a remark\n\n",
        "nothing.url": "http://a.b/empty",
        "My page.html": html.replace("Some", "Other"),
        "scan_1.pages": "\n".join(json.dumps({"page_no": k, "text": f"page {k} with some text"}) for k in (2, 1)),
        "broken.pages": "{nonsense\n",
        "void.pages": json.dumps({"page_no": 1, "text": " "}),
        "unknown.tmp": "leave me",
        "---.html": html,
    }
    for name, text in files.items():
        (box / name).write_text(text)

    def accept(documents):
        for r in documents.collect():
            seen.setdefault(r.doc_id, []).append((r.title, r.body, r.source_format, os.path.basename(r.file)))

    def go():
        inbox.watch_inbox(spark, f"file://{box}", accept, fetched, f"file://{tmp_path}/checkpoint").awaitTermination(180)

    go()
    assert sorted(p for p in os.listdir(box) if not p.startswith(".")) == ["failed", "unknown.tmp"]
    parked = {p for p in os.listdir(box / "failed") if not p.startswith((".", "_r"))}
    assert parked == {"half.url", "words.txt", "blank.txt", "nothing.url", "broken.pages", "void.pages", "---.html"}
    reasons = {os.path.basename(r.file): r.reason for r in inbox.failed_files(spark, f"file://{box}").collect()}
    assert reasons == {
        "half.url": "not fetched: http://not.there/x", "words.txt": "no URL: no url at all", "blank.txt": "no URLs", "nothing.url": "no content",
        "broken.pages": "no pages", "void.pages": "no content", "---.html": "no name",
    }
    one = next(k for k in seen if k.startswith("a-b-c-"))
    assert {x[3] for x in seen[one]} == {"good.txt", "half.url"} and seen[one][0][:2] == ("T", "# H\n\nSome text.")
    assert seen["my-page"][0][1] == "# H\n\nOther text." and seen["scan-1"][0][:2] == ("scan 1", "## Page 1\n\npage 1 with some text\n\n## Page 2\n\npage 2 with some text")
    assert len(seen) == 3
    # Again over the same checkpoint: only what is new, and a parked file once it has been put back.
    seen.clear()
    (box / "more.url").write_text("http://a.b/c")
    (box / "half-again.url").write_text("http://a.b/c\n")
    go()
    assert list(seen) == [one] and {x[3] for x in seen[one]} == {"more.url", "half-again.url"}
    assert sorted(p for p in os.listdir(box) if not p.startswith(".")) == ["failed", "unknown.tmp"]
    seen.clear()
    go()
    assert not seen


def test_catch_up(spark):
    documents = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    chunks = spark.createDataFrame([("b", 1), ("b", 2), ("z", 3)], "doc_id string, vector_id long")
    assert {r.doc_id for r in inbox.catch_up(documents, chunks).collect()} == {"a", "c"}
