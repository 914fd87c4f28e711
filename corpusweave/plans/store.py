"""A corpus kept as tables of files: documents are replaced and removed bucket by bucket, rebuilds become visible at once.

Layout below the root folder:

* ``state/cache``: embedded texts; it outlives rebuilds
* ``derived/v=N/<table>/bucket=B``: everything that can be built again, each row in the bucket of its document
* ``derived/v=N/manifest``, ``derived/v=N/report``: what the version was built with, and the documents that it skipped
* ``derived/v=N/_READY``: an empty file, written last. The version read is the highest that has one.

Replacing documents rewrites the buckets that they lie in, and no others, over all tables. The new rows are staged before any
bucket is touched, and every step can be repeated: after a failure in between, the same call completes it. There is one writer.
"""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, graph
from .embedding import CACHE_SCHEMA, Embedder, embed_with_cache
from .lineage import cut, shared_folder

_EDGE = "src_chunk long, dst_chunk long, src_doc string, dst_doc string, kind string, similarity double, surprise double"
SCHEMAS = {
    "documents": "doc_id string, kind string, project string, title string, categories array<string>, links array<string>, published_at string",
    "chunks": "doc_id string, vector_id long, chunk_id string, section_type string, heading string, ordinal int, page int, text string,"
    " tokens long, content_hash string, embedding array<float>",
    "tags": "doc_id string, tag string",
    "outline": "doc_id string, pos int, title string, page int",
    # An edge lies in the buckets of both its documents: doc_id is the one that it lies here for.
    "edges": f"doc_id string, {_EDGE}",
}


@dataclass(frozen=True)
class Config:
    """What vectors and chunks are made with. Another model or length makes stored vectors useless, other chunks only old."""

    model: str
    dim: int
    model_version: int = 1
    chunk_tokens: int = 512
    neighbors: int = 6
    min_similarity: float = 0.5
    min_distance: float = 1.0


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(", ")]


class Store:
    """A corpus below ``root``. ``buckets`` is fixed when a version is built."""

    def __init__(self, spark: SparkSession, root: str, config: Config, buckets: int = 64):
        self.spark, self.root, self.config, self.buckets = spark, root.rstrip("/"), config, buckets

    # Files

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        where, fs = self._fs(path)
        return fs.exists(where)

    def _delete(self, path: str) -> None:
        where, fs = self._fs(path)
        fs.delete(where, True)

    def _versions(self) -> list[int]:
        where, fs = self._fs(f"{self.root}/derived")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(where) if s.getPath().getName().startswith("v="))

    def version(self) -> int:
        """The version that is read; 0 before the first build."""
        return max((v for v in self._versions() if self._exists(f"{self.root}/derived/v={v}/_READY")), default=0)

    def _at(self, name: str, version: int | None = None) -> str:
        return f"{self.root}/derived/v={version or self.version()}/{name}"

    # Reading

    def check(self) -> int:
        """The version that is read. Vectors of another model or length are an error, another chunk size is a warning."""
        version = self.version()
        if not version:
            raise ValueError(f"nothing is built in {self.root}")
        built = self.spark.read.parquet(self._at("manifest", version)).first()
        want = (self.config.model, self.config.model_version, self.config.dim)
        if (built["model"], built["model_version"], built["dim"]) != want:
            raise ValueError(f"the vectors are of {built['model']} {built['model_version']} with {built['dim']} dimensions, not of {want}: rebuild")
        if built["buckets"] != self.buckets:
            raise ValueError(f"the tables have {built['buckets']} buckets, not {self.buckets}")
        if built["chunk_tokens"] != self.config.chunk_tokens:
            warnings.warn(f"chunks of {built['chunk_tokens']} tokens stay until the next rebuild", stacklevel=2)
        return version

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of :data:`SCHEMAS`, or ``report``."""
        version = version or self.check()
        if name == "report":
            return self.spark.read.schema("doc_id string, reason string").parquet(self._at(name, version))
        rows = self._stored(name, version)
        rows = rows.filter(F.col("doc_id") == F.col("src_doc")) if name == "edges" else rows
        return rows.select(*(c for c in _names(SCHEMAS[name]) if name != "edges" or c != "doc_id"))

    def _stored(self, name: str, version: int) -> DataFrame:
        return self.spark.read.schema(f"{SCHEMAS[name]}, bucket int").parquet(self._at(name, version))

    def cache(self) -> DataFrame:
        path = f"{self.root}/state/cache"
        return self.spark.read.schema(CACHE_SCHEMA).parquet(path) if self._exists(path) else self.spark.createDataFrame([], CACHE_SCHEMA)

    # Writing

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int"))

    def _touched(self, docs: DataFrame) -> list[int]:
        return sorted(r[0] for r in self._bucket(docs.select("doc_id")).select("bucket").distinct().collect())  # a row per bucket

    def _overwrite(self, name: str, version: int, rows: DataFrame, touched: list[int]) -> None:
        """Put ``rows`` in place of all rows of the touched buckets."""
        staged = f"{shared_folder(self.spark)}/store-{uuid.uuid4().hex}"
        self._bucket(rows.select(*_names(SCHEMAS[name]))).write.parquet(staged)
        ready = self.spark.read.schema(f"{SCHEMAS[name]}, bucket int").parquet(staged)
        path = self._at(name, version)
        ready.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        filled = {r[0] for r in ready.select("bucket").distinct().collect()}  # a row per bucket
        for b in set(touched) - filled:  # overwriting by bucket leaves those alone that no row is for
            self._delete(f"{path}/bucket={b}")
        self._delete(staged)

    def _replace(self, ids: DataFrame, tables: dict[str, DataFrame], version: int) -> None:
        touched = self._touched(ids)
        for name in ("documents", "chunks", "tags", "outline"):
            old = self._stored(name, version).filter(F.col("bucket").isin(touched)).drop("bucket").join(ids, "doc_id", "left_anti")
            rows = old.unionByName(tables[name].select(*old.columns)) if name in tables else old
            self._overwrite(name, version, rows, touched)

    def _connect(self, ids: DataFrame, version: int) -> None:
        """Edges of these documents anew: in their buckets and those of the documents at the other ends."""
        # Rows that lie under a document name all its edges, so the other ends are found in its own bucket.
        own = self._stored("edges", version).filter(F.col("bucket").isin(self._touched(ids))).join(ids, "doc_id", "left_semi")
        fresh = graph.surprise_edges(self._pairs(version, ids), self.config.min_similarity, self.config.min_distance)
        staged = f"{shared_folder(self.spark)}/store-{uuid.uuid4().hex}"
        _mirrored(fresh).write.parquet(staged)
        fresh = self.spark.read.schema(SCHEMAS["edges"]).parquet(staged)
        ends = own.select(F.explode(F.array("src_doc", "dst_doc")).alias("doc_id")).union(fresh.select("doc_id")).union(ids)
        touched = self._touched(ends)
        stored = self._stored("edges", version).filter(F.col("bucket").isin(touched)).drop("bucket")
        kept = graph.drop_incident(stored, ids)
        self._overwrite("edges", version, kept.unionByName(fresh).dropDuplicates(["doc_id", "src_chunk", "dst_chunk", "kind"]), touched)
        self._delete(staged)

    def _pairs(self, version: int, changed: DataFrame | None = None) -> DataFrame:
        about = self._stored("documents", version).select("doc_id", "categories")
        chunks = self._stored("chunks", version).select("doc_id", "vector_id", "section_type", "embedding").join(about, "doc_id")
        return graph.edge_pairs(chunks, self.config.neighbors, changed)

    def _built(self, docs: DataFrame, embedder: Embedder) -> dict[str, DataFrame]:
        """All tables but the edges; new vectors go to the cache."""
        texts = docs.select("doc_id", "abstract", "notes_md", "title", F.when(F.col("kind") == "reflection", None).otherwise(F.col("body")).alias("sections_md"), F.when(F.col("kind") == "reflection", F.col("body")).alias("reflection_md"))
        chunks = chunking.build_chunks(texts, self.config.chunk_tokens)
        embedded, fresh = embed_with_cache(chunks, self.cache(), embedder, self.config.model, self.config.model_version, self.config.dim)
        # Writing is what makes the vectors last; a later failure finds them in the cache.
        fresh.write.mode("append").parquet(f"{self.root}/state/cache")
        embedded = embed_with_cache(chunks, self.cache(), embedder, self.config.model, self.config.model_version, self.config.dim)[0]
        outline = docs.select("doc_id", F.posexplode("outline").alias("pos", "o")).select("doc_id", "pos", "o.title", "o.page") if "outline" in docs.columns else None
        headed = embedded.withColumn("vector_id", F.xxhash64("chunk_id"))
        if outline is not None:
            matched = chunking.match_outline(headed.filter("heading is not null").select("doc_id", "place", "heading"), outline)
            headed = headed.join(matched.withColumnRenamed("page", "matched_page"), ["doc_id", "place"], "left")
        else:
            headed = headed.withColumn("matched_page", F.lit(None).cast("int"))
        paged = chunking.fill_pages(headed)
        out = {
            "documents": docs.select(*_names(SCHEMAS["documents"])),
            "chunks": paged.select(*_names(SCHEMAS["chunks"])),
            "tags": docs.select("doc_id", F.explode(F.array_distinct("tags")).alias("tag")),
        }
        return out if outline is None else out | {"outline": outline}

    def replace_documents(self, docs: DataFrame, embedder: Embedder) -> None:
        """Put documents in place of those with their ids, whole: chunks, tags, outline and edges.

        ``docs``: as :func:`..sources.files.body_of_kind` reads them, and maybe ``outline``, an array of ``title`` and ``page`` in
        order. Rows without an id are skipped; of rows with one id, one counts.
        """
        version = self.check()
        docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
        ids = cut(docs.select("doc_id"))
        self._replace(ids, self._built(docs, embedder), version)
        self._connect(ids, version)

    def remove_documents(self, docs: DataFrame) -> None:
        """Take documents (``doc_id``) out of all tables, with every edge that has an end in one."""
        version = self.check()
        ids = cut(docs.select("doc_id").filter("doc_id is not null").distinct())  # it may be read from tables that change now
        self._replace(ids, {}, version)
        self._connect(ids, version)

    def rebuild(self, docs: DataFrame, embedder: Embedder, broken: DataFrame | None = None, keep: int = 1) -> int:
        """A new version of all derived tables from all documents; cached vectors are used. Returns its number.

        It becomes visible at once, when all of it is written; a build that fails leaves the version before as it is. Documents
        without an id or a text, further rows with one id, and those of ``broken`` (``doc_id``, ``reason``) are skipped and
        reported. ``keep`` versions before it stay.
        """
        version = max([0, *self._versions()]) + 1
        blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
        reason = F.when(F.col("doc_id").isNull(), "no id").when(blank("body") & blank("abstract") & blank("notes_md"), "no text")
        told = docs.withColumn("reason", reason)
        good = told.filter("reason is null").drop("reason").dropDuplicates(["doc_id"])
        report = told.filter("reason is not null").select("doc_id", "reason")
        again = told.filter("reason is null").groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit("id given more than once").alias("reason"))
        report = report.unionByName(again)
        if broken is not None:
            report = report.unionByName(broken.select("doc_id", "reason"))
        report.write.parquet(self._at("report", version))
        tables = self._built(good, embedder)
        for name, schema in SCHEMAS.items():
            where, fs = self._fs(self._at(name, version))
            fs.mkdirs(where)
            if name in tables:
                self._bucket(tables[name].select(*_names(schema))).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(self._at(name, version))
        edges = _mirrored(graph.surprise_edges(self._pairs(version), self.config.min_similarity, self.config.min_distance))
        self._bucket(edges).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._at("edges", version))
        c = self.config
        self.spark.createDataFrame([(c.model, c.model_version, c.dim, c.chunk_tokens, self.buckets)], "model string, model_version int, dim int, chunk_tokens int, buckets int").coalesce(1).write.parquet(self._at("manifest", version))
        where, fs = self._fs(self._at("_READY", version))
        fs.create(where).close()
        for v in self._versions():
            if v < version - keep:
                self._delete(f"{self.root}/derived/v={v}")
        return version

    def collect_garbage(self, docs: DataFrame) -> None:
        """Remove documents that ``docs`` (``doc_id``) doesn't have any more, and cached vectors that no chunk holds."""
        self.remove_documents(self.table("documents").join(docs.select("doc_id"), "doc_id", "left_anti").select("doc_id"))
        held = self.cache().join(self.table("chunks").select("content_hash").distinct(), "content_hash", "left_semi")
        staged = f"{self.root}/state/cache-{uuid.uuid4().hex}"
        held.write.parquet(staged)
        self._delete(f"{self.root}/state/cache")
        old, fs = self._fs(staged)
        fs.rename(old, self._fs(f"{self.root}/state/cache")[0])


def _mirrored(edges: DataFrame) -> DataFrame:
    ends = edges.withColumn("doc_id", F.explode(F.array("src_doc", "dst_doc")))
    return ends.select(*_names(SCHEMAS["edges"]))
