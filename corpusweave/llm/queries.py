"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    clustering,
    decontaminate,
    exact_dedup,
    fill_middle,
    html_extract,
    jaccard_join,
    langid,
    license_scan,
    packing,
    quality,
    token_output,
    toxicity,
)
from .common import held_out

VOCABULARY = "byte_bpe_50k.json"
PACKING_VOCABULARY = "word_bpe_49k.json"
END_ID = 2


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the vocabulary file lies; the same on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: a folder per source and hundred ids, whose first document is its licence file."""
    hundred = F.floor(F.col("doc_id") / 100)
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    return docs.select("doc_id", "text", F.concat_ws("/", "source", hundred.cast("string"), name).alias("path"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_paths(table(spark, sf_dir, "documents"))
    found = license_scan.license_scan(files.select("path", "text"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    hundred = F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).cast("long")
    doc_id = F.when(name == "LICENSE", hundred * 100).otherwise(F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("long"))
    return found.select(doc_id.alias("doc_id"), "path", "license", "score", "line", "origin", "from_path")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def _judged(docs: DataFrame, scores: DataFrame, modulus: int, remainder: int, least: float) -> DataFrame:
    return scores.select(
        "doc_id",
        held_out(F.col("doc_id"), modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def _known(modulus: int, remainder: int) -> Column:
    return ~held_out(F.col("doc_id"), modulus, remainder)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), _known(3, 1))
    return _judged(docs, toxicity.score(docs, model), 3, 1, 0.7)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_output.token_round_trip(table(spark, sf_dir, "documents"), vocabulary_path(), END_ID)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), _known(5, 0))
    return _judged(docs, quality.score(docs, model), 5, 0, 0.3)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, _known(4, 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(PACKING_VOCABULARY), end_id=END_ID)
    return packing.piece_table(packed)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = fill_middle.frame_store(table(spark, sf_dir, "documents"))
    found = fill_middle.digests(fill_middle.fill_in_middle(store, seed=7, rate=100, spm=50))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clustering.integer_vectors(table(spark, sf_dir, "embeddings"), 64)
    found = clustering.centroid_clusters(kept, clusters=16, rounds=3, seed=1)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_license_scan,
        op2_exact_dedup,
        op3_toxicity,
        op4_token_output,
        op5_html_extract,
        op6_quality,
        op7_jaccard_join,
        op8_bpe,
        op9_langid,
        op10_decontaminate,
        op11_packing,
        op12_fill_middle,
        op13_clustering,
        pipeline,
    )
    return {f.__name__: f for f in own}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op10_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        i AS (SELECT item_id, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0),
        grams AS (
            SELECT DISTINCT item_id, size, array_to_string(w[k + 1:k + size], ' ') AS gram
            FROM (SELECT *, unnest(range(len(w) - size + 1)) AS k FROM i)),
        sizes AS (SELECT DISTINCT size FROM grams),
        placed AS (
            SELECT doc_id, size, k, array_to_string(w[k + 1:k + size], ' ') AS gram
            FROM (SELECT d.*, size, unnest(range(len(w) - size + 1)) AS k FROM d, sizes WHERE len(w) >= size)),
        hits AS (SELECT doc_id, placed.size, k, item_id FROM placed JOIN grams USING (size, gram)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(listed, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
