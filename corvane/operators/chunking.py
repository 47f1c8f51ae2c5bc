"""Documents to passages by a sliding window of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators.numbering import numbered


def chunk(docs: DataFrame, size: int = 120, overlap: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """passage_id, doc_id, chunk, text, n_words: windows of size words, each with the last overlap words of the one before.

    The last window may be shorter.  A text without words has none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    words = docs.select(F.col(id_col).alias("doc_id"), tx.words(F.col(text_col)).alias("w"))
    w, n = F.col("w"), F.size("w")
    # null without words, which explodes to nothing; a filter on n would move below and split each text again
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap, F.lit(1)) - 1, F.lit(size - overlap)))
    passage = lambda s: F.struct(F.array_join(F.slice(w, s + 1, size), " ").alias("text"), F.least(n - s, F.lit(size)).alias("n_words"))
    cut = words.select("doc_id", F.posexplode(F.transform(starts, passage)).alias("chunk", "x"))  # only finished passages leave the row
    return cut.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk").cast("string")).alias("passage_id"), "doc_id", "chunk", F.col("x.text").alias("text"), F.col("x.n_words").alias("n_words"))


def passage_metadata(metadata, doc_id, title, chunk):
    """A document's metadata with doc_id, title and chunk, which win over keys of the same name."""
    names = ("doc_id", "title", "chunk")
    own = F.create_map(*(x for n, c in zip(names, (doc_id, title, chunk)) for x in (F.lit(n), c.cast("string"))))
    return F.map_concat(F.map_filter(metadata, lambda k, v: ~k.isin(*names)), own)


def batch_numbers(df: DataFrame, size: int, order: str, by: str) -> DataFrame:
    """df with batch: consecutive rows of each by, in that order, size at a time."""
    if size < 1:
        raise ValueError("size must be positive")
    rows = numbered(df, by, order, "batch")
    return rows.withColumn("batch", F.floor((F.col("batch") - 1) / size))
