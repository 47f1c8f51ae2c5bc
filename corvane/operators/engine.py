"""From documents to ranked pages: extractors, an embedder, a store and a scorer, joined."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from time import perf_counter
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corvane.errors import UnsupportedFormatError
from corvane.functions import files as fx
from corvane.functions import vectors as vx
from corvane.operators import index as ix
from corvane.operators import search as sx
from corvane.operators.embedders import Embedder, image_key  # noqa: F401
from corvane.operators.filters import FilterSpec, Query
from corvane.operators.index import IndexStore
from corvane.operators.keyed import KeyedIndex
from corvane.sources.files import framed


class PageExtractor(Protocol):
    """Documents with content to one row a page: all columns but content, page (from 1) and image, what is embedded; of RGB bytes width and height as well.

    A document that cannot be read gives no row.
    """

    def __call__(self, documents: DataFrame) -> DataFrame: ...


def text_pages(documents: DataFrame) -> DataFrame:
    """Pages of texts, which form feeds part; pages without text count, but are left out."""
    pages = F.split(F.col("content").cast("string"), "\f")
    rest = [c for c in documents.columns if c != "content"]
    each = documents.select(*rest, F.posexplode(pages).alias("place", "__text")).where(F.trim("__text") != "")
    return each.select(*rest, (F.col("place") + 1).alias("page"), F.col("__text").cast("binary").alias("image"))


def rgb_page(documents: DataFrame) -> DataFrame:
    """Raw RGB bytes, a page a document; bytes that are no whole pixels cannot be read."""
    rest = [c for c in documents.columns if c != "content"]
    return documents.where((F.length("content") > 0) & (F.length("content") % 3 == 0)).select(*rest, F.lit(1).alias("page"), F.col("content").alias("image"))


def frame_pages(documents: DataFrame) -> DataFrame:
    """TIFF and GIF images, a page a frame: its RGB bytes, width and height."""
    return framed(documents).withColumnRenamed("pixels", "image")


#: Extractors by format.
EXTRACTORS: dict[str, PageExtractor] = {"txt": text_pages, "rgb": rgb_page, "tiff": frame_pages, "gif": frame_pages}


@dataclass
class Timings:
    """Milliseconds by stage; each stage must run an action to be measured."""

    stages: dict[str, float]

    @contextmanager
    def measure(self, stage: str) -> Iterator[None]:
        began = perf_counter()
        try:
            yield
        finally:
            self.stages[stage] = self.stages.get(stage, 0.0) + 1000 * (perf_counter() - began)

    def throughput(self, stage: str, items: int) -> float:
        """Items a second; 0 if the stage took no time."""
        took = self.stages.get(stage, 0.0)
        return 1000 * items / took if took else 0.0


class Engine:
    """index() and search() over exchangeable parts.

    documents: doc_id, version_id, file, format, content, and metadata columns named
    meta_x for a field x, which win over file, format and page.  The index is the store's
    Parquet; no step holds it on the driver.
    """

    def __init__(self, embedder: Embedder, store: IndexStore, scorer: Callable[[Column, Column], Column] | None = None, extractors: dict[str, PageExtractor] | None = None):
        self.embedder, self.store = embedder, store
        self.scorer = scorer or vx.scorer(multi=embedder.multi_vector)
        self.extractors = EXTRACTORS if extractors is None else extractors

    def pages(self, documents: DataFrame) -> DataFrame:
        """The pages of all documents.  Fails if a document's format has no extractor."""
        formats = {r["format"] for r in documents.select("format").distinct().collect()}  # few
        if missing := sorted(str(f) for f in formats - set(self.extractors)):
            raise UnsupportedFormatError(f"no extractor for {', '.join(missing)}")
        found = [self.extractors[f](documents.where(F.col("format") == f)) for f in sorted(formats)] or [text_pages(documents)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)

    def index(self, documents: DataFrame, reinit: bool = True) -> Engine:
        """Embeds every page and replaces the index, or with reinit false adds to it."""
        pages = self.pages(documents)
        meta = [c.removeprefix("meta_") for c in pages.columns if c.startswith("meta_")]
        image = F.col("image")
        if {"width", "height"} <= set(pages.columns):
            image = F.when(F.col("width").isNull(), image).otherwise(self.embedder.of_image(image, F.col("width"), F.col("height")))
        rows = pages.withColumn("embedding", self.embedder.column(image)).drop("image", "width", "height")
        self.store.save(ix.payload(rows, meta), reinit)
        return self

    def query_column(self, text: str) -> Column:
        vector = self.embedder.embed_query(text).tolist()
        return vx.multi_vector(vector) if self.embedder.multi_vector else vx.vector(vector[0] if isinstance(vector[0], list) else vector)

    def search(self, query: Query | str, top_k: int | None = None, spec: FilterSpec | dict[str, Any] | None = None) -> DataFrame:
        """The best pages with score, normalized_score (over the whole index) and rank; fails if the index is empty."""
        query = query if isinstance(query, Query) else Query(query, FilterSpec.of(spec))
        k = top_k if top_k is not None else query.top_k if query.top_k is not None else 10
        scored = self.scorer(self.query_column(query.text), F.col("embedding"))
        return sx.search(self.store.load(), scored, k, query.filters, normalized=True, tie=["file", "page"], check_empty=True).drop("embedding")

    def __len__(self) -> int:
        return self.store.count()


@dataclass(frozen=True)
class SearchResult:
    """hits: as many rows as were asked for at most; took_ms: until they were there."""

    query: Query
    hits: list[Row]
    took_ms: float


class SearchService:
    """Searches that say how long they took; a Query for nothing but white space is an EmptyQueryError."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def execute(self, query: Query | str, top_k: int | None = None) -> SearchResult:
        query = query if isinstance(query, Query) else Query(query)
        timings = Timings({})
        with timings.measure("search"):
            hits = self.engine.search(query, top_k).orderBy("rank").collect()
        return SearchResult(query, hits, timings.stages["search"])


class IndexService:
    """Indexing that says how many pages there are then, and how long it took."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def execute(self, documents: DataFrame, reinit: bool = True) -> tuple[int, float]:
        timings = Timings({})
        with timings.measure("index"):
            pages = len(self.engine.index(documents, reinit))
        return pages, timings.stages["index"]


def display_value(score: Column, normalized: Column) -> Column:
    """What is shown of a result: the normalised score if there is one."""
    return F.coalesce(normalized, score)


def annotation(results: DataFrame) -> DataFrame:
    """doc_id, version_id, page, score: results as annotations, which show display_value()."""
    return results.select("doc_id", "version_id", "page", display_value(F.col("score"), F.col("normalized_score")).alias("score"))


def merged_metadata(old: Column, new: Column) -> Column:
    """Both maps; the new one wins."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def in_input_order(responses: DataFrame, inputs: DataFrame, on: str = "index") -> DataFrame:
    """A server's answers beside what was asked, by the index that they carry and in its order; none is lost or made up."""
    both = inputs.join(responses.withColumn("__found", F.lit(True)), on, "full")
    whole = F.assert_true(F.col("__found").isNotNull() & F.col(on).isNotNull(), "an input has no answer")
    return both.where(whole.isNull()).drop("__found").orderBy(on)


def ingest(passages: DataFrame, embedder: Embedder, store: KeyedIndex, text: str = "text") -> int:
    """Embeds passages in Arrow batches and upserts them by the store's key; returns how many came in.

    Of passages with one key the last counts, within a call and between calls; the buckets
    that have none of them are not touched.  With the same passages again the index says
    the same.
    """
    return store.upsert(passages.withColumn("embedding", embedder.column(F.col(text).cast("binary"))))


def export_manifest(pages: DataFrame, path: str, metadata: list[str] | None = None) -> None:
    """Writes a manifest: a JSON line for each file with file, format, pages, and metadata as a map of strings, the least where a file's pages differ.

    pages: file, format, a row a page (or with pages 0 none yet), and the metadata columns.
    """
    names = metadata or []
    values = F.create_map(*(x for n in names for x in (F.lit(n), F.min(F.col(n).cast("string"))))) if names else F.create_map().cast("map<string,string>")
    pages.groupBy("file", "format").agg(F.sum("pages").cast("long").alias("pages") if "pages" in pages.columns else F.count("*").alias("pages"), values.alias("metadata")).write.mode("overwrite").json(path)


def load_manifest(spark, path: str) -> DataFrame:
    """file, format, pages, metadata of a manifest that export_manifest() wrote."""
    return spark.read.schema("file string, format string, pages long, metadata map<string,string>").json(path)


def discovered_entries(files: DataFrame) -> DataFrame:
    """Entries of files that are not indexed yet: pages 0, and their checksum for the metadata.  files: path, format, checksum."""
    return files.select(F.col("path").alias("file"), "format", F.lit(0).cast("long").alias("pages"), "checksum", fx.stable_id("doc", F.col("path")).alias("doc_id"))


def ready(checks: DataFrame) -> DataFrame:
    """One row: whether all checks (name, ok) hold, and the names of those that don't; no check is ready."""
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ready"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))).alias("failing"))


def event(kind: str, **fields: Column) -> Column:
    """A struct of event_type, occurred_at (UTC, ISO 8601) and the fields."""
    at = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return F.struct(F.lit(kind).alias("event_type"), at.alias("occurred_at"), *(c.alias(n) for n, c in fields.items()))


def document_versions(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep, doc_id, version_id, document_path, filename, title, checksum, document_metadata (format): a document and its version for each file; paths may repeat.  files: path, format, checksum if there is one, and the columns in keep."""
    checksum = F.col("checksum") if "checksum" in files.columns else F.lit(None).cast("string")
    kept = {"checksum": checksum, "document_metadata": F.create_map(F.lit("format"), F.col("format"))}
    rows = ix.input_documents(files, keep={c: F.col(c) for c in keep or []} | kept).withColumnRenamed("file", "document_path")
    return rows.select(*(keep or []), "doc_id", "version_id", "document_path", "filename", "title", "checksum", "document_metadata")


def log_line(event: str, **fields: Column) -> Column:
    """A JSON line: the event's name, then the fields."""
    return F.to_json(F.struct(F.lit(event).alias("event"), *(c.alias(n) for n, c in fields.items())))
