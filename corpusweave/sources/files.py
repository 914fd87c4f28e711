"""Sources: document folders, feeds, URL lists, web articles and pages of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import arxiv_id, squeeze, strip, valid_url

METADATA_SCHEMA = (
    "doc_id string, kind string, project string, links array<string>, version string, title string, authors array<string>, abstract string,"
    " categories array<string>, published_at string, updated_at string, ingested_at string, source_format string, source_url string,"
    " tags array<string>, schema_version int, _corrupt_record string"
)
# Fixed value: the body file of each kind of document.
BODY_FILES = {"paper": "sections.md", "note": "idea.md", "reflection": "reflection.md"}


def _folder(file: str = "_metadata.file_path"):
    return F.regexp_extract(F.col(file), r"([^/]+)/[^/]+$", 1)


def read_metadata(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Readable metadata records with defaults filled in, and the folders whose record is broken or newer."""
    raw = spark.read.schema(METADATA_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/metadata.json")
    rows = raw.withColumn("folder", _folder())
    bad = F.col("_corrupt_record").isNotNull() | (F.coalesce("schema_version", F.lit(1)) > 1)
    empty = F.array().cast("array<string>")
    good = rows.filter(~bad).drop("_corrupt_record").withColumns(
        {"kind": F.coalesce("kind", F.lit("paper")), "doc_id": F.coalesce("doc_id", "folder")} | {c: F.coalesce(c, empty) for c in ("links", "authors", "categories", "tags")}
    )
    return good, rows.filter(bad).select("folder", F.concat(F.lit("(metadata.json unreadable for "), "folder", F.lit(")")).alias("title"))


def read_bodies(spark: SparkSession, root: str) -> DataFrame:
    """``folder``, ``name`` and ``body`` of the Markdown files of all document folders."""
    rows = spark.read.text(f"{root}/*/*.md", wholetext=True).select(_folder().alias("folder"), F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("name"), F.col("value").alias("body"))
    return rows.filter(F.col("name").isin(*BODY_FILES.values(), "notes.md"))


def body_of_kind(metadata: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each document with the body of its kind, and its notes (null where the file is missing)."""
    wanted = F.create_map(*(F.lit(x) for pair in BODY_FILES.items() for x in pair))
    main = bodies.select("folder", F.col("name").alias("__name"), F.col("body"))
    notes = bodies.filter("name = 'notes.md'").select("folder", F.col("body").alias("notes_md"))
    return metadata.withColumn("__name", wanted[F.col("kind")]).join(main, ["folder", "__name"], "left").join(notes, "folder", "left").drop("__name")


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds: ``doc_id``, ``version``, ``title``, ``abstract``, ``authors``, ``categories``,
    ``published_at``, ``updated_at``. Entries without a title or a known id are skipped."""
    schema = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    doc_id, version = arxiv_id(F.col("id"))
    return rows.select(
        doc_id.alias("doc_id"),
        version.alias("version"),
        squeeze(F.col("title")).alias("title"),
        squeeze(F.col("summary")).alias("abstract"),
        F.transform("author", lambda a: squeeze(a["name"])).alias("authors"),
        F.transform("category", lambda c: c["_term"]).alias("categories"),
        F.col("published").alias("published_at"),
        F.col("updated").alias("updated_at"),
    ).filter("doc_id is not null and title <> ''")


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blank lines and comments are skipped. ``url``, ``valid``."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("url"))
    return rows.filter("url <> '' and not startswith(url, '#')").withColumn("valid", valid_url(F.col("url")))


def extract_articles(pages: DataFrame, url: str = "url", source: str = "html") -> tuple[DataFrame, DataFrame]:
    """Articles as Markdown by rules (``title``, ``markdown``), and the pages without content.

    Scripts, styles, menus, adverts and footers go; headings become ``#`` lines, paragraphs are apart by a blank
    line; entities of the common kind are decoded. A page without a title is called by its URL.
    """
    page = F.col(source)
    title = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_replace(page, r"(?is)<!--.*?(-->|$)|<(script|style|nav|footer|aside|form|head)\b.*?</\2\s*>|<div class=\"ad\">.*?</div>", " ")
    article = F.regexp_extract(body, r"(?is)<article[^>]*>(.*)</article>", 1)
    text = F.when(article == "", body).otherwise(article)
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?is)<h{level}[^>]*>\s*(.*?)\s*</h{level}\s*>", "\n\n" + "#" * level + " $1\n\n")
    text = F.regexp_replace(text, r"(?i)<(p|div|section|ul|ol|li|table|tr|blockquote)\b[^>]*>|</(p|div|section|ul|ol|li|table|tr|blockquote)\s*>", "\n\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        title, text = F.replace(title, F.lit(name), F.lit(sign)), F.replace(text, F.lit(name), F.lit(sign))
    text = strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n"))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    rest = [c for c in pages.columns if c != source]
    out = pages.select(*rest, F.coalesce(F.nullif(squeeze(title), F.lit("")), F.col(url)).alias("title"), text.alias("markdown"))
    return out.filter("markdown <> ''"), out.filter("markdown = '' or markdown is null").select(*rest, F.lit("no content").alias("reason"))


def join_pages(pages: DataFrame, recovered: DataFrame | None = None, least: int = 24, key: str = "doc_id") -> DataFrame:
    """Bodies from pages of text (``key``, ``page_no``, ``text``): a heading per page, and ``blank_pages``.

    Pages of fewer than ``least`` characters are replaced by recovered text that isn't blank.
    """
    rows = pages.select(key, "page_no", F.coalesce("text", F.lit("")).alias("text")).withColumn("blank", F.char_length(strip(F.col("text"))) < least)
    if recovered is not None:
        other = recovered.select(key, "page_no", F.col("text").alias("__text"))
        rows = rows.join(other, [key, "page_no"], "left")
        rows = rows.withColumn("text", F.when(F.col("blank") & (strip(F.coalesce("__text", F.lit(""))) != ""), F.col("__text")).otherwise(F.col("text")))
    block = F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"), strip(F.col("text")))
    listed = F.array_sort(F.collect_list(F.struct("page_no", block.alias("block"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n").alias("body"), F.sum(F.col("blank").cast("long")).alias("blank_pages"))


def first_page_of(chunks: DataFrame, section: str, key: str = "doc_id") -> DataFrame:
    """The page of a document's first chunk of a section."""
    own = Window.partitionBy(key).orderBy("vector_id")
    return chunks.filter(F.col("section_type") == section).withColumn("__n", F.row_number().over(own)).filter("__n = 1").select(key, "page")
