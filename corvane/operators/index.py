"""Index tables: building rows, appending, replacing, upserting, counting, and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.errors import IndexStoreError
from corvane.functions import files as fx
from corvane.operators.numbering import numbered

#: Payload columns that metadata may override, and those it may not.
OVERRIDABLE, RESERVED = ("file", "format", "page"), ("document", "document_version")


def payload(df: DataFrame, metadata: list[str]) -> DataFrame:
    """df with its metadata columns, named meta_x for x, spread over the row: they win over file, format and page."""
    if bad := [m for m in metadata if m in RESERVED]:
        raise ValueError(f"metadata may not replace {bad}")
    out = [F.coalesce(F.col(f"meta_{c}").cast(df.schema[c].dataType), F.col(c)).alias(c) if c in metadata and c in OVERRIDABLE else F.col(c) for c in df.columns if not c.startswith("meta_")]
    return df.select(*out, *(F.col(f"meta_{m}").alias(m) for m in metadata if m not in df.columns))


def input_documents(paths: DataFrame, path: str = "path", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, version_id, file, filename, title, format of each path, and what is to be kept; ids follow from the path."""
    p = F.col(path)
    return paths.select(*(c.alias(n) for n, c in (keep or {}).items()), fx.stable_id("doc", p).alias("doc_id"), fx.stable_id("ver", p).alias("version_id"), p.alias("file"), fx.filename(p).alias("filename"), fx.stem(p).alias("title"), fx.format_of(p).alias("format"))


def append(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Both, duplicates included."""
    return index.unionByName(rows)


def zipped(embeddings: DataFrame, payloads: DataFrame, on: str = "ordinal", strict: bool = False) -> DataFrame:
    """Rows of equal ordinal; strict: it fails if one side has an ordinal that the other lacks."""
    if not strict:
        return embeddings.join(payloads, on)
    both = embeddings.withColumn("__a", F.lit(1)).join(payloads.withColumn("__b", F.lit(1)), on, "full")
    whole = F.assert_true(F.col("__a").isNotNull() & F.col("__b").isNotNull(), "embeddings and payloads differ in length")
    return both.where(whole.isNull()).drop("__a", "__b")


def upsert(index: DataFrame, rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row for each key: the values written last, at the ordinal of the first.  seq: the order of writing; it becomes ordinal."""
    every = index.unionByName(rows)
    rest = [c for c in every.columns if c not in (key, seq)]
    last = every.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("x"), F.min(seq).alias("ordinal"))
    return last.select(key, "ordinal", *(F.col(f"x.{c}").alias(c) for c in rest))


class IndexStore:
    """An index as Parquet at a path; without a path it can neither be saved nor loaded."""

    def __init__(self, spark: SparkSession, path: str | None = None, compression: str = "zstd"):
        self.spark, self.path, self.compression = spark, path, compression

    def _at(self) -> str:
        if not self.path:
            raise IndexStoreError("this index is kept in memory only")
        return self.path

    def save(self, rows: DataFrame, reinit: bool = True) -> None:
        """Replaces the index, or with reinit false adds to it."""
        rows.write.option("compression", self.compression).mode("overwrite" if reinit else "append").parquet(self._at())

    def load(self) -> DataFrame:
        if not self.exists():
            raise IndexStoreError(f"no index at {self.path}")
        return self.spark.read.parquet(self._at())

    def exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self._at())
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def count(self) -> int:
        """Rows; 0 if there is no index."""
        return self.load().count() if self.exists() else 0

    def clear(self, schema: T.StructType) -> None:
        self.save(self.spark.createDataFrame([], schema))


def manifest(index: DataFrame) -> DataFrame:
    """file, format, pages: one row for each indexed file."""
    return index.groupBy("file", "format").agg(F.count("*").alias("pages"))


def manifest_json(entries: DataFrame, created_at: Column | None = None) -> DataFrame:
    """One row with json: the time and all entries (file, format, pages, and metadata as a map if there is one), by file and format.  A manifest is a list of files, small beside the index."""
    parts = ["file", "format", "pages", *(["metadata"] if "metadata" in entries.columns else [])]
    place = lambda x: F.struct(x["file"], x["format"])  # noqa: E731  maps have no order
    by_file = F.array_sort(F.collect_list(F.struct(*parts)), lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0))
    at = created_at if created_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return entries.groupBy().agg(by_file.alias("entries")).select(F.to_json(F.struct(at.alias("created_at"), "entries")).alias("json"))


def parsed_manifest(rows: DataFrame, col: str = "json") -> DataFrame:
    """file, format, pages, metadata (empty if there is none) from manifests as JSON."""
    kind = "created_at string, entries array<struct<file: string, format: string, pages: long, metadata: map<string,string>>>"
    entries = rows.select(F.explode(F.from_json(col, kind)["entries"]).alias("x"))
    return entries.select("x.file", "x.format", "x.pages", F.coalesce("x.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def shown(results: DataFrame, metadata: list[str]) -> DataFrame:
    """results with line: rank, scores, path, format, page and metadata other than the format."""
    pairs = F.array_compact(F.array(*(F.when(F.col(m).isNotNull(), F.concat(F.lit(f"{m}="), F.col(m).cast("string"))) for m in metadata if m != "format")))
    said = F.format_string("%d. [%.3f] [%.3f] %s (%s) — page %d", F.col("rank").cast("int"), F.coalesce("score", F.lit(0.0)), F.coalesce("normalized_score", F.lit(0.0)), F.col("file"), F.coalesce("format", F.lit("?")), F.col("page").cast("int"))
    return results.withColumn("line", F.concat(said, F.when(F.size(pairs) > 0, F.concat(F.lit("  ("), F.array_join(pairs, " | "), F.lit(")"))).otherwise("")))


def validated(df: DataFrame, rules: list[dict]) -> Column:
    """Messages for each row, by rules: dicts of name, type (a Spark type's simple name), required, choices.

    A null counts as missing.  A value of another type than the rule's is reported, booleans for numbers included.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    groups = {"int": ("int", "bigint", "smallint", "tinyint"), "float": ("double", "float"), "str": ("string",), "bool": ("boolean",)}
    out = []
    for r in rules:
        name, kind = r["name"], kinds.get(r["name"])
        column = F.col(name) if kind else F.lit(None)
        if r.get("required"):
            out.append(F.when(column.isNull(), F.lit(f"missing required field: {name}")))
        if kind and kind not in groups[r.get("type", "str")]:
            out.append(F.when(column.isNotNull(), F.lit(f"field {name} expected type {r.get('type', 'str')}, got {kind}")))
        elif kind and r.get("choices") is not None:
            out.append(F.when(column.isNotNull() & ~column.isin(*r["choices"]), F.concat(F.lit(f"field {name} not in choices: "), column.cast("string"))))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def row_numbered(pages: DataFrame, by: str, order: str) -> DataFrame:
    """pages with page: the place within by, from 1."""
    return numbered(pages, by, order, "page").withColumn("page", F.col("page").cast("int"))
