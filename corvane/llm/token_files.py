"""Token files: Parquet with one list of ids for each document, in ascending order of doc_id.

Each file is one range of doc_id.  Ids are dictionary-encoded in row groups of a
set size and pages of few rows, with page indexes, so that a reader who wants
some documents, or the metadata columns alone, reads little else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import UNITS_BYTES, chunks, ids_and_texts, new_path
from corvane.llm.units import WITH_SPACE, unit_encoder

FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
#: How the files are written.
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.row.count.limit": "500",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding where a column has too many values for a dictionary
}


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encodes every whole text by the byte-level tokenizer file at path and writes token files to the folder out.

    A null or empty text has end_id alone.  Documents come in ascending doc_id,
    a null doc_id first; rows that share a doc_id are ordered by text.  No row is
    dropped.  An empty table makes a folder without rows.  Columns other than the
    two named are not read.  Only doc_id and text are shuffled, once.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in chunks(batch, limit=UNITS_BYTES):
                ids, at = unit_encoder(path, WITH_SPACE).encode(some.column("text"), end_id)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.full(len(some), part, np.int32)), pa.array(before + at[:-1]), pa.array(np.diff(at)), lists], ["doc_id", "part", "part_start", "n_tokens", "ids"])
                before += int(at[-1])

    ordered = ids_and_texts(docs, id_col, text_col).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.options(**WRITE_OPTIONS).mode("overwrite").parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, and start: the ids of all documents before it.

    start is the sum of the parts before, of which there are as many as files, and
    what the file says.  Filters on doc_id reach the page indexes; columns that are
    not selected are not read.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each file
    return files.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens as counted in ids, and ids_crc32 of the ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at, values = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<i4", copy=False))
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int, out: str | None = None) -> DataFrame:
    """Writes token files, by default to the shared folder, and returns what they hold, by document."""
    out = out or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, out, end_id)
    return with_crc32(read_tokens(docs.sparkSession, out))
