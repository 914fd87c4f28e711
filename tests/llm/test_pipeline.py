"""The pipeline: its stages' contracts, and its decisions against brute force on a small table."""

import shutil

import corpus_pipeline
import pyarrow as pa
from corpusweave.llm import jaccard_join, quality
from pyspark.sql import functions as F


def test_pipeline(spark, tmp_path):
    words = [f"w{i}" for i in range(200)]
    text = lambda s: " ".join(words[(s * 37 + k * k * (s + 3)) % 200] for k in range(60))
    rows = [(i, text(i), "en", "s", 300) for i in range(40)]
    rows += [(100 + i, text(i).upper(), "en", "s", 300) for i in range(5)]  # equal but for case: the larger id stays
    rows += [(200 + i, text(i + 10) + " tail", "en", "s", 300) for i in range(5)]  # near copies: the smaller id stays
    rows += [(300 + i, "bad!!! " * 50 + str(i), "en", "s", 300) for i in range(40)]
    labels = [(i, int(i < 300), 0) for i, *_ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, text(20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id for r in out.collect()}
    want = {i for i in range(5, 40) if i != 20} | {100 + i for i in range(5)}
    assert kept == want
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, str(tmp_path)).columns == docs.columns
    assert out.filter(F.col("n_tokens") > 0).count() == len(want)
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_stages_take_small_pieces_of_text(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "x", 1)], "doc_id long, text string, n_chars long")
    tasks, sizes = [], []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, schema: tasks.append(task) or self)
    quality.keep_good(docs, {"prior": 1.0})
    jaccard_join._describe(docs, "doc_id", "text", 5, 80, 100, sets=False)
    text = pa.array(["some words of a text " * 100] * 1000)
    batch = pa.record_batch({"id": pa.array(range(1000)), "doc_id": pa.array(range(1000)), "text": text, "n_chars": pa.array([2100] * 1000)})
    for task in tasks:
        out = list(task(iter([batch])))
        sizes += [x.num_rows * 2100 for x in out]
        assert sum(x.num_rows for x in out) == 1000
    assert len(tasks) == 2 and max(sizes) <= 500_000
