"""Document fingerprints: threshold-scaled sketches.

A sketch holds every shingle hash below a fixed fraction of the hash range; that of
a text with few shingles holds all of them and says so, since few would be below.
Two sketches are compared by the hashes below the fraction, or by all if both are
whole, so that they estimate how much of one document another holds, however unequal
their lengths.  Sketches merge by union: the merged sketch is that of the documents
taken together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chunks, ids_and_texts, shingle_sets

#: Words in a shingle, the fraction of hashes that a sketch keeps, and up to how many shingles it keeps all.
WORDS, FRACTION, FEW = 5, 1 / 8, 64


class Sketch(NamedTuple):
    """Sorted distinct hashes; whole: whether they are all of the document's, else they are those below the fraction."""

    hashes: np.ndarray
    whole: bool

    def below(self, fraction: float = FRACTION) -> np.ndarray:
        return self.hashes[: int(np.searchsorted(self.hashes, np.uint64(int(fraction * 2**64) - 1), side="right"))]


def sketch(hashes: np.ndarray, fraction: float = FRACTION, few: int = FEW) -> Sketch:
    """Of a document's sorted distinct hashes."""
    return Sketch(hashes, True) if len(hashes) <= few else Sketch(Sketch(hashes, True).below(fraction), False)


def merged(a: Sketch, b: Sketch, fraction: float = FRACTION, few: int = FEW) -> Sketch:
    """The sketch of two documents taken together, exactly as sketch() would give it."""
    if a.whole and b.whole:
        return sketch(np.union1d(a.hashes, b.hashes), fraction, few)
    return Sketch(np.union1d(a.below(fraction), b.below(fraction)), False)


def as_text(found: Sketch) -> str:
    """= or ~ for a whole or a scaled sketch, then 16 hexadecimal digits for each hash, ascending; nothing for a text without words."""
    if found.whole and not len(found.hashes):
        return ""
    return "~="[found.whole] + found.hashes.astype(">u8").tobytes().hex()


def from_text(text: str) -> Sketch:
    return Sketch(np.frombuffer(bytes.fromhex(text[1:]), ">u8").astype(np.uint64), not text.startswith("~"))


def _common(a: Sketch, b: Sketch, fraction: float) -> tuple[int, int, int]:
    """How many comparable hashes a has, how many b, and how many both."""
    x, y = (a.hashes, b.hashes) if a.whole and b.whole else (a.below(fraction), b.below(fraction))
    return len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))


def likeness(a: Sketch, b: Sketch, fraction: float = FRACTION) -> float:
    """Estimated share of common shingles among all of both, exact if both sketches are whole; 1 for two texts without words, 0 for one such.

    The standard error is sqrt(s * (1 - s) / n) for a share s and n hashes below the
    fraction in both together; 0 if there are none.
    """
    m, n, both = _common(a, b, fraction)
    if m + n == both:
        return float(a.whole and b.whole)
    return both / (m + n - both)


def containment(a: Sketch, b: Sketch, fraction: float = FRACTION) -> float | None:
    """Estimated share of a's shingles that b has; 1 if a has none, None if none of a's hashes is below the fraction.

    The standard error is sqrt(c * (1 - c) / n) for a share c and n hashes of a below the fraction.
    """
    m, _, both = _common(a, b, fraction)
    if not m:
        return 1.0 if a.whole and not len(a.hashes) else None
    return both / m


def fingerprints(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION, few: int = FEW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint: one row for each row in, of its whole text, however long.

    A text without words, null included, has the empty string.  An empty table gives
    an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = [as_text(sketch(x, fraction, few)) for x in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def _range_of(key: Column, edges: list[int]) -> Column:
    """How many of the ascending edges are up to key, in two steps over about a square root of them each."""
    if not edges:
        return F.lit(0)
    step = math.isqrt(len(edges)) + 1
    every = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<long>")
    upto = lambda xs: F.size(F.filter(xs, lambda e: e <= key))
    block = upto(every(edges[step::step])) if len(edges) > step else F.lit(0)
    return block * step + upto(F.slice(every(edges), block * step + 1, F.lit(step)))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (part, extra, doc_id, text), in each task ordered so that a row's next row is the next document.

    Documents go to ranges of doc_id, in one shuffle; the first of each range goes
    to the range before as well, marked extra, and the very first to the last range.
    Rows that share a doc_id are ordered by text; a null doc_id comes first.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    key = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    part = _range_of(key, edges)
    spread = docs.select("doc_id", "text", key.alias("key"), part.alias("part"))
    firsts = sorted((r["part"], r["key"]) for r in spread.groupBy("part").agg(F.min("key").alias("key")).collect())  # a row for each range
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    marks = spark.createDataFrame(before, "key long, before int")
    both = spread.join(F.broadcast(marks), "key", "left").select("doc_id", "text", "key", F.explode(F.when(F.col("before").isNull(), F.array(F.struct("part", F.lit(0).alias("extra")))).otherwise(F.array(F.struct("part", F.lit(0).alias("extra")), F.struct(F.col("before").alias("part"), F.lit(1).alias("extra"))))).alias("at"))
    return both.select("at.part", "at.extra", "doc_id", "text", "key").repartitionById(parts, "part").sortWithinPartitions("part", "extra", "key", "text").drop("key")


def digests(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION, few: int = FEW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_edited, in_next.

    The edited text has its last quarter of code points replaced by the beginning of
    the next document, in ascending doc_id; the first follows the last.  A null text
    is empty, and an empty one stays empty when edited.  near_* are likenesses, in_*
    the containments of the document in the other (null where nothing can be told).
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "in_next"]

    def finished(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts = [r[2] for r in rows]
        own = [sketch(x, fraction, few) for x in shingle_sets(pa.array(texts, pa.string()), words)]
        at = [k for k in range(len(rows) - 1) if not rows[k][0]]
        edited = [texts[k][: len(texts[k]) - len(texts[k]) // 4] + texts[k + 1][: len(texts[k]) // 4] for k in at]
        new = [sketch(x, fraction, few) for x in shingle_sets(pa.array(edited, pa.string()), words)]
        columns = [
            pa.array([rows[k][1] for k in at], pa.int64()),
            pa.array([len(texts[k]) for k in at], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array([as_text(own[k]) for k in at], pa.string()),
            pa.array([*map(as_text, new)], pa.string()),
            *(pa.array([f(own[k], x, fraction) for k, x in zip(at, others)], pa.float64()) for f in (likeness, containment) for others in (new, [own[k + 1] for k in at])),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for some in chunks(batch):
                rows = held + [*zip(some.column("extra").to_pylist(), some.column("doc_id").to_pylist(), (x or "" for x in some.column("text").to_pylist()))]
                yield from finished(rows)
                held = rows[-1:]

    ordered = with_next(ids_and_texts(docs, id_col, text_col))
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double")
