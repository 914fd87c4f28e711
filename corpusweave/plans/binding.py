"""The test tables as a corpus: chunks, documents, queries and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The closed list of section types.
SECTIONS = (
    "abstract introduction background method experiments applications limitations future_work conclusion user_notes reflection other"
).split()
AS_OF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """One chunk per vector; ``text`` joins the texts, which is only done where a query needs them."""
    v = F.col("vec_id")
    out = table(spark, sf_dir, "embeddings").select(
        v.alias("vector_id"),
        F.floor(v / 5).alias("doc_id"),
        F.element_at(F.array(*map(F.lit, SECTIONS)), (v % 12 + 1).cast("int")).alias("section_type"),
        F.col("label").cast("long").alias("label"),
        "embedding",
        F.when(v % 50 != 49, F.date_sub(F.lit(AS_OF).cast("date"), (v % 400).cast("int")).cast("timestamp")).alias("embedded_at"),
    )
    if text:
        texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vector_id"), "text", "source", "lang")
        out = out.join(texts, "vector_id", "left")
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per five chunks, with kind, project, categories and links."""
    d = F.col("doc_id")
    kind = F.when(d % 10 == 8, "note").when(d % 10 == 9, "reflection").when(d % 10 != 7, "paper")
    return (
        chunks(spark, sf_dir)
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("label")).alias("categories"), F.count(F.lit(1)).alias("n_chunks"))
        .select(
            "doc_id",
            "n_chunks",
            "categories",
            kind.alias("kind"),
            F.when(d % 20 == 8, "global").when(d % 20 == 18, "p1").alias("project"),
            F.array((d * 7 + 3) % 100, (d * 11) % 120).alias("links"),
        )
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks(spark, sf_dir).filter("vector_id % 100 = 0")
    return own.select(F.col("vector_id").alias("query_id"), F.col("doc_id").alias("query_doc"), "embedding")


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short queries: the first eight words of every hundredth text."""
    texts = table(spark, sf_dir, "documents").filter("doc_id % 100 = 0")
    words = F.slice(F.split("text", r"\s+"), 1, 8)
    return texts.select(F.col("doc_id").alias("query_id"), F.array_join(words, " ").alias("query"))


def phrase_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries with a hyphen between their first two words."""
    return query_texts(spark, sf_dir).select("query_id", F.regexp_replace("query", r"^(\S+) ", "$1-").alias("query"))


def corpus_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth chunk with its vector, and the query of its text where it has one."""
    return query_vectors(spark, sf_dir).join(query_texts(spark, sf_dir), "query_id", "left")


#: The same tables for SQL.
SQL = f"""
chunks AS (
    SELECT vec_id AS vector_id, vec_id // 5 AS doc_id,
        [{", ".join(f"'{s}'" for s in SECTIONS)}][vec_id % 12 + 1] AS section_type,
        CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS embedding,
        CASE WHEN vec_id % 50 <> 49 THEN CAST(DATE '{AS_OF}' - CAST(vec_id % 400 AS INTEGER) AS TIMESTAMP) END AS embedded_at
    FROM embeddings),
docs AS (
    SELECT doc_id, count(*) AS n_chunks, list_sort(list_distinct(list(label))) AS categories,
        CASE doc_id % 10 WHEN 8 THEN 'note' WHEN 9 THEN 'reflection' WHEN 7 THEN NULL ELSE 'paper' END AS kind,
        CASE doc_id % 20 WHEN 8 THEN 'global' WHEN 18 THEN 'p1' END AS project,
        [(doc_id * 7 + 3) % 100, (doc_id * 11) % 120] AS links
    FROM chunks GROUP BY doc_id),
query_vectors AS (
    SELECT vector_id AS query_id, doc_id AS query_doc, embedding FROM chunks WHERE vector_id % 100 = 0),
query_texts AS (
    SELECT doc_id AS query_id, array_to_string(string_split_regex(text, '\\s+')[1:8], ' ') AS query
    FROM documents WHERE doc_id % 100 = 0)"""
