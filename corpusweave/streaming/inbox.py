"""An inbox of dropped files as a stream: parsed by extension, taken in, and parked where they can't be.

Known are lists of URLs (``.url``, ``.txt``), web pages (``.html``, ``.htm``) and pages of text (``.pages``: JSON lines with ``page_no`` and
``text``, as text recognition leaves them). The stream doesn't look at any other file, so unknown ones stay where they are.
A list of URLs is taken in as far as its pages are there, and is parked all the same if one isn't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import slug, strip, title_of_file, url_id, valid_url
from ..sources.files import extract_articles, join_pages
from ..operators.corpus import orphans

#: Extensions of lists of URLs, of web pages and of pages of text.
LISTS, PAGES, TEXTS = ("url", "txt"), ("html", "htm"), ("pages",)
DOCUMENT = ("doc_id", "title", "body", "source_format", "source_url", "file")


def _name(file: Column) -> Column:
    """The file's name; paths of files are URIs, in which a plus sign is one."""
    return F.url_decode(F.replace(F.regexp_extract(file, r"([^/]+)$", 1), F.lit("+"), F.lit("%2B")))


def _stem(file: Column) -> Column:
    return F.regexp_replace(_name(file), r"\.[^.]*$", "")


def parse_files(files: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of files (``file``, ``extension``, ``value``), and the files that failed: ``file``, ``reason``.

    ``fetched``: ``url``, ``html`` of pages that URLs stand for. Documents have the columns of :data:`DOCUMENT`; their ids come
    from the URL or the file's name, so a file that comes again gives the same document. Of several reasons one is told.
    """
    lists = files.filter(F.col("extension").isin(*LISTS))
    lines = lists.select("file", F.explode(F.split("value", "\n")).alias("line")).select("file", strip(F.col("line")).alias("url"))
    urls = lines.filter("url <> '' and not startswith(url, '#')").distinct()
    named = urls.withColumn("valid", valid_url(F.col("url"))).join(fetched.select("url", "html").dropDuplicates(["url"]), "url", "left")
    missing = F.when(~F.col("valid"), F.concat(F.lit("no URL: "), "url")).when(F.col("html").isNull(), F.concat(F.lit("not fetched: "), "url"))
    failed = named.select("file", missing.alias("reason")).filter("reason is not null")
    none = lists.join(urls, "file", "left_anti").select("file", F.lit("no URLs").alias("reason"))
    pages = named.filter("valid and html is not null").select("file", "url", "html", url_id(F.col("url")).alias("doc_id"))
    dropped = files.filter(F.col("extension").isin(*PAGES)).select("file", _name(F.col("file")).alias("url"), F.col("value").alias("html"), slug(_stem(F.col("file"))).alias("doc_id"))
    articles, empty = extract_articles(pages.unionByName(dropped))
    of_pages = articles.select("doc_id", "title", F.col("markdown").alias("body"), F.lit("html").alias("source_format"), F.col("url").alias("source_url"), "file")
    texts = files.filter(F.col("extension").isin(*TEXTS))
    read = texts.select("file", F.explode(F.split("value", "\n")).alias("line")).filter(F.trim("line") != "")
    read = read.select("file", F.from_json("line", "page_no int, text string").alias("p")).select("file", "p.page_no", "p.text")
    bad = read.groupBy("file").agg(F.max(F.col("page_no").isNull()).alias("bad"), F.max(F.coalesce(strip(F.col("text")), F.lit("")) != "").alias("filled"))
    told = texts.join(bad, "file", "left")
    reason = F.when(F.coalesce("bad", F.lit(True)), "no pages").when(~F.col("filled"), "no content")
    told = told.select("file", reason.alias("reason"))
    whole = read.join(told.filter("reason is null").select("file"), "file", "left_semi")
    of_texts = join_pages(whole, key="file").select(
        slug(_stem(F.col("file"))).alias("doc_id"), title_of_file(_name(F.col("file"))).alias("title"), "body", F.lit("pages").alias("source_format"), F.lit(None).cast("string").alias("source_url"), "file"
    )
    documents = of_pages.unionByName(of_texts)
    failures = failed.unionByName(none).unionByName(empty.select("file", "reason")).unionByName(told.filter("reason is not null"))
    failures = failures.unionByName(documents.filter("doc_id is null").select("file", F.lit("no name").alias("reason")))
    return documents.filter("doc_id is not null"), failures.groupBy("file").agg(F.min("reason").alias("reason"))


def catch_up(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that have no chunk yet, as those that came while nothing ran."""
    return orphans(documents, chunks, "doc_id")


def _move(spark: SparkSession, file: str, folder: str | None) -> None:
    """Move a file into a folder, or delete it; one that is gone has been dealt with before."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    where = path(spark._jvm.java.net.URI(file))
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return
    if folder is None:
        fs.delete(where, False)
        return
    fs.mkdirs(path(folder))
    target = path(folder, where.getName())
    fs.delete(target, False)
    fs.rename(where, target)


def watch_inbox(
    spark: SparkSession, folder: str, accept: Callable[[DataFrame], None], fetched: DataFrame, checkpoint: str, files_a_batch: int = 1000
):
    """Start a query that takes in what lies in ``folder``: ``accept`` gets each batch's documents and must be idempotent, as a batch may
    come again after a failure. Files that gave documents are then deleted; failed ones go to ``folder/failed``, and a row with the
    reason to ``folder/failed/_reasons``, so that they aren't tried again until someone puts them back.

    The driver handles names of files only, ``files_a_batch`` of them at most. The trigger is "what is there now": start it again, with
    the same checkpoint, as often as wanted.
    """
    known = "|".join([*LISTS, *PAGES, *TEXTS]).replace("|", ",")
    stream = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).option("ignoreMissingFiles", True)
    rows = stream.text(f"{folder}/*.{{{known}}}")
    file = F.col("_metadata.file_path")
    rows = rows.select(file.alias("file"), F.lower(F.regexp_extract(file, r"\.([^./]+)$", 1)).alias("extension"), "value")

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            documents, failures = parse_files(batch, fetched)
            accept(documents)
            failures = failures.persist()
            parked = {r["file"] for r in failures.select("file").collect()}  # files_a_batch at most
            if parked:
                failures.write.mode("overwrite").parquet(f"{folder}/failed/_reasons/batch={number}")
            for r in batch.select("file").distinct().collect():  # files_a_batch at most
                _move(spark, r["file"], f"{folder}/failed" if r["file"] in parked else None)
            failures.unpersist()
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failed_files(spark: SparkSession, folder: str) -> DataFrame:
    """What was parked and why: ``file``, ``reason``."""
    return spark.read.schema("file string, reason string").parquet(f"{folder}/failed/_reasons")
