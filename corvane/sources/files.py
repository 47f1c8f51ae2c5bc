"""Files as tables: discovery, corpora, statistics of load runs, gold lists."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.errors import CorpusError, UnsupportedFormatError
from corvane.functions import files as fx

CORPUS = "id string, title string, text string, metadata map<string,string>"
EMPTY = "path string, length long"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def listed(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, length of all files below root, and content if asked for; the bytes are read only then.  A missing root has none."""
    columns = ["path", "length", *(["content"] if content else [])]
    if not exists(spark, root):
        return spark.createDataFrame([], EMPTY + (", content binary" if content else ""))
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(*columns)


def iter_files(spark: SparkSession, root: str, suffixes: Iterable[str] | None = None) -> DataFrame:
    """Files whose suffix is one of suffixes, as it is spelled, whatever the case; by path."""
    files = listed(spark, root)
    if suffixes is not None:
        wanted = [s.strip().lower().lstrip(".") for s in suffixes]
        files = files.where(F.coalesce(fx.suffix(F.col("path")).isin(wanted), F.lit(False)))
    return files.orderBy("path")


def known(files: DataFrame, suffixes: Iterable[str] | None = None) -> DataFrame:
    """files (path) with format, those of known formats; both sides of an allow-list are made canonical."""
    files = files.withColumn("format", fx.format_of(F.col("path"))).where("format is not null")
    return files if suffixes is None else files.where(F.col("format").isin([fx.canonical(s) for s in suffixes]))


def discover(spark: SparkSession, root: str, suffixes: Iterable[str] | None = None, with_checksum: bool = False) -> DataFrame:
    """path, format, length (and checksum) of documents below root, as known() takes them; by path."""
    files = known(listed(spark, root, with_checksum), suffixes)
    if with_checksum:
        files = files.withColumn("checksum", fx.checksum(F.col("content"))).drop("content")
    return files.orderBy("path")


def count_by_format(files: DataFrame) -> DataFrame:
    return files.groupBy("format").agg(F.count("*").alias("files"))


def renderers(files: DataFrame, table: dict[str, str]) -> DataFrame:
    """files with renderer, by format; fails if a format has none.  table: format to renderer's name, a row for each format."""
    known = files.sparkSession.createDataFrame([*table.items()], "format string, renderer string")
    missing = [r["format"] for r in files.select("format").distinct().join(F.broadcast(known), "format", "left_anti").collect()]  # formats are few
    if missing:
        raise UnsupportedFormatError(f"no renderer for {', '.join(sorted(map(str, missing)))}")
    return files.join(F.broadcast(known), "format")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of every line of text files.

    Splits of a file are read by tasks of their own, each in order; a line's number is its
    place in the split, after the lines of the splits before, which a first pass counts.
    """
    place = F.monotonically_increasing_id()  # goes up by one from line to line of a split
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__split"), place.alias("__place"))
    splits = lines.groupBy("file", "__split").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "__split", (before - F.col("__first") + 1).alias("__shift"))  # a row a split
    return lines.join(starts, ["file", "__split"]).select("file", (F.col("__place") + F.col("__shift")).alias("line"), "value")


def _entries(lines: DataFrame) -> tuple[DataFrame, Column]:
    """Lines that are not blank with x, what they say, and which of them cannot be read."""
    bad = F.col("x.id").isNull() | F.col("x.title").isNull() | F.col("x.text").isNull()
    return lines.where(F.trim("value") != "").withColumn("x", F.from_json("value", CORPUS)), bad


def read_jsonl(spark: SparkSession, path: str, strict: bool = True, numbered: bool = False) -> DataFrame:
    """id, title, text, metadata of each line that is not blank, and file and line if numbered; strict: a bad line is an error that gives its number and quotes it."""
    lines, bad = _entries(spark.read.text(path))
    if strict and not lines.where(bad).isEmpty():
        at = line_errors(spark, path).orderBy("file", "line").first()  # only now lines are numbered
        raise CorpusError(f"{at['file']}, line {at['line']}: cannot read {at['excerpt']!r}")
    if numbered:
        lines, bad = _entries(numbered_lines(spark, path))
    metadata = F.coalesce("x.metadata", F.create_map().cast("map<string,string>")).alias("metadata")
    return lines.where(~bad).select(*(["file", "line"] if numbered else []), "x.id", "x.title", "x.text", metadata)


def line_errors(spark: SparkSession, path: str) -> DataFrame:
    """file, line, excerpt of the lines that cannot be read; lines count from 1 in each file."""
    lines, bad = _entries(numbered_lines(spark, path))
    return lines.where(bad).select("file", "line", F.substring("value", 1, 80).alias("excerpt"))


def number(c: Column) -> Column:
    """A figure of a statistics file; blank or N/A is 0."""
    return F.when(c.isNull() | F.trim(c).isin("", "N/A"), F.lit(0.0)).otherwise(c.try_cast("double"))


def row_key(kind: Column, name: Column) -> Column:
    return F.when(name == "Aggregated", F.lit("Aggregated")).otherwise(F.trim(F.concat_ws(" ", kind, name)))


def read_stats(spark: SparkSession, prefix: str, run: str) -> DataFrame:
    """run, row_key, requests, failures, rps, p50, p95, p99 of prefix_stats.csv."""
    raw = spark.read.option("header", True).csv(f"{prefix}_stats.csv")
    figures = {"rps": "Requests/s", "p50": "50%", "p95": "95%", "p99": "99%"}
    return raw.select(F.lit(run).alias("run"), row_key(F.col("Type"), F.col("Name")).alias("row_key"), *(number(F.col(f"`{c}`")).cast("long").alias(n) for n, c in (("requests", "Request Count"), ("failures", "Failure Count"))), *(number(F.col(f"`{c}`")).alias(n) for n, c in figures.items()))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """query_id, ranked, relevant from a JSON list."""
    rows = spark.read.schema("ranked array<string>, relevant array<string>").option("multiLine", True).json(path)
    return rows.select(F.monotonically_increasing_id().alias("query_id"), "ranked", "relevant")


#: What the documents of the made-up corpus are about, and how they say it.
TOPICS = ("leave requests", "travel expenses", "laptop replacement", "badge access", "password resets", "meeting rooms", "parking permits", "health cover", "training budgets", "remote days")
SENTENCE = "Rule {n} on {topic}: ask within {days} days, up to {amount} euros, and expect an answer in {hours} hours."


def synthetic_corpus(spark: SparkSession, n: int, seed: int = 1234) -> DataFrame:
    """id, title, text, metadata of n documents that go through the topics in turn; the same seed gives the same.

    A figure is taken from the first 8 hexadecimal digits of the SHA-256 of id, its name and the seed, joined by colons.
    """
    return synthetic_documents(spark.range(n), seed)


def synthetic_documents(ids: DataFrame, seed: int = 1234) -> DataFrame:
    """synthetic_corpus() for the numbers in ids (id), a document each."""
    digest = lambda name: F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(name), F.lit(str(seed))), 256)
    pick = lambda name, low, high: F.conv(F.substring(digest(name), 1, 8), 16, 10).cast("long") % (high - low + 1) + low
    topic = F.element_at(F.array(*map(F.lit, TOPICS)), (F.pmod("id", F.lit(len(TOPICS))) + 1).cast("int"))
    text = F.lit(SENTENCE)
    for slot, value in {"topic": topic, "n": F.col("id"), "days": pick("days", 2, 30), "amount": pick("amount", 50, 900), "hours": pick("hours", 4, 72)}.items():
        text = F.replace(text, F.lit("{" + slot + "}"), value.cast("string"))
    return ids.select(F.format_string("doc-%04d", "id").alias("id"), topic.alias("title"), text.alias("text"), F.create_map(F.lit("topic"), topic).alias("metadata"))


def synthetic_questions(spark: SparkSession, n: int = 50) -> DataFrame:
    """question_id, question of n questions that go through the topics in turn."""
    return questions_for(spark.range(n))


def questions_for(ids: DataFrame) -> DataFrame:
    """synthetic_questions() for the numbers in ids (id), a question each."""
    topic = F.element_at(F.array(*map(F.lit, TOPICS)), (F.pmod("id", F.lit(len(TOPICS))) + 1).cast("int"))
    return ids.select(F.col("id").alias("question_id"), F.concat(F.lit("What is the rule on "), topic, F.lit("?")).alias("question"))


def synthetic_pages(spark: SparkSession, n: int, width: int = 64, height: int = 80) -> DataFrame:
    """file, page, bucket, width, height, pixels: pages of one colour each, as RGB bytes."""
    return coloured_pages(spark.range(n), width, height)


def coloured_pages(ids: DataFrame, width: int = 64, height: int = 80) -> DataFrame:
    """synthetic_pages() for the numbers in ids (id), a page each."""
    colour = F.concat(*(F.lpad(F.hex(F.pmod(F.col("id") * F.lit(k), F.lit(256))), 2, "0") for k in (37, 59, 83)))
    return ids.select(F.format_string("page_%05d.png", "id").alias("file"), F.lit(1).alias("page"), F.pmod("id", F.lit(10)).alias("bucket"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.unhex(F.repeat(colour, width * height)).alias("pixels"))


#: Suffixes of images that can have several frames; Spark's own reader takes the others, of one frame.
FRAMED = ("tiff", "tif", "gif")


def framed(files: DataFrame, content: str = "content") -> DataFrame:
    """files without content, and page (from 1), width, height, pixels (RGB bytes): a row for each frame of each image.

    content: bytes of TIFF or GIF images.  One that cannot be read whole has no row.
    """

    @F.pandas_udf("array<struct<width: int, height: int, pixels: binary>>")
    def read(images: pd.Series) -> pd.Series:
        from corvane.sources.frames import frames

        def one(image: bytes | None) -> list[dict]:
            try:
                return [{"width": w, "height": h, "pixels": p} for w, h, p in frames(image or b"")]
            except ValueError:
                return []

        return pd.Series([one(x) for x in images])

    rest = [c for c in files.columns if c != content]
    each = files.select(*rest, F.posexplode(read(content)).alias("__place", "__frame"))
    return each.select(*rest, (F.col("__place") + 1).alias("page"), "__frame.width", "__frame.height", "__frame.pixels")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """file, page, width, height, pixels: each image as RGB bytes, those of several frames a row for each; files that cannot be read are left out."""
    any_case = lambda names: "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in n) for n in names) + "}"
    single = any_case(n for n in (*fx.IMAGES, "jfif") if n not in FRAMED)
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", single).load(root).select("image.*")
    chains = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", any_case(FRAMED)).load(root).select(F.col("path").alias("file"), "content")

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        import numpy as np

        def turned(x: bytes, n: int) -> bytes:
            a = np.frombuffer(x, np.uint8).reshape(-1, n)
            return (np.repeat(a, 3, axis=1) if n == 1 else a[:, 2::-1]).tobytes()

        return pd.Series([turned(x, int(n)) for x, n in zip(data, channels)])

    one = images.select(F.col("origin").alias("file"), F.lit(1).alias("page"), "width", "height", rgb("data", "nChannels").alias("pixels"))
    return one.unionByName(framed(chains))


def resized(pages: DataFrame, longest: int) -> DataFrame:
    """pages (width, height, pixels as RGB bytes) with the longer side at most longest: each new pixel is the mean of the area that it stands for.

    Sizes are those of fitted(); smaller pages stay as they are.  Pixels of other length than
    width and height say have none after it.
    """
    size = F.struct(*(fx.fitted(F.col("width").cast("int"), F.col("height").cast("int"), longest)[c].alias(c) for c in ("width", "height")))

    @F.pandas_udf("binary")
    def scaled(pixels: pd.Series, width: pd.Series, height: pd.Series, to: pd.DataFrame) -> pd.Series:
        import numpy as np

        def weights(old: int, new: int) -> np.ndarray:
            """new x old: the share of each old row in each new one."""
            edges = np.arange(new + 1) * old / new
            low, high = np.maximum(edges[:-1, None], np.arange(old)), np.minimum(edges[1:, None], np.arange(1, old + 1))
            return np.maximum(high - low, 0) * new / old

        def one(x: bytes | None, w: int, h: int, new_w: int, new_h: int) -> bytes | None:
            if x is None or len(x) != w * h * 3 or (w, h) == (new_w, new_h):
                return x if x is not None and len(x) == w * h * 3 else None
            rows = weights(h, new_h) @ np.frombuffer(x, np.uint8).reshape(h, w * 3).astype(np.float64)
            whole = np.einsum("vw,hwc->hvc", weights(w, new_w), rows.reshape(new_h, w, 3), optimize=True)
            return np.floor(whole + 0.5).clip(0, 255).astype(np.uint8).tobytes()

        return pd.Series([one(x, int(w), int(h), int(a), int(b)) for x, w, h, a, b in zip(pixels, width, height, to["width"], to["height"])])

    fitted = pages.withColumn("__to", size).withColumn("pixels", scaled("pixels", "width", "height", "__to"))
    return fitted.withColumns({"width": F.col("__to.width"), "height": F.col("__to.height")}).drop("__to")


def mean_colour(pixels: Column) -> Column:
    """Mean red, green and blue of RGB bytes, from 0 to 1."""

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([(np.frombuffer(x, np.uint8).reshape(-1, 3).mean(0) / 255).tolist() for x in xs])

    return run(pixels)
