"""Best-fit packing of documents' tokens into sequences of a fixed size.

Hierarchical residual packing: each partition packs its pieces by best fit,
longest first, and emits the bins that are nearly full.  Underfull bins are
items of the next round, in which groups of partitions merge, and so on up a
tree.  After best fit two bins of a group never fit together, so at most one is
half full or less.  At a level above, then, at most FAN_IN - 1 bins can vanish in a group,
each into one that is more than half full, and an emptier one can take whatever a fuller
one can.  So a group hands up its bin up to half full, and FAN_IN of the emptiest
others for every level still to come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import UNITS_BYTES, chunks, ids_and_texts, stored
from corvane.llm.units import BLACK, unit_encoder

FAN_IN = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"
MERGES = "bin long, parent long, shift long, fill long, up boolean"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: the bin and offset of each item, and the fill of each bin.

    Bins are kept by free space, and a bit set tells which amounts of space exist.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, fills = 0, []
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        if large := there >> size:
            space = size + (large & -large).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                there ^= 1 << space
        else:
            b, space = len(fills), capacity
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += size
        by_space[space - size].append(b)
        there |= 1 << (space - size)
    return bins, offsets, np.array(fills, np.int64)


def pack_local(docs: DataFrame, path: str, capacity: int, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """The pieces of all documents, with the bins of their partition.  A task keeps some 50 bytes a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for some in chunks(batch, limit=UNITS_BYTES):
                ids, at = unit_encoder(path, BLACK).encode(some.column("text"), end_id)
                size = np.diff(at)
                pieces = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, size[doc] - start)
                raw, first = memoryview(ids).cast("B"), 4 * (at[doc] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist())]
                parts.append(pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]))
        if sum(p.num_rows for p in parts):
            table = pa.Table.from_batches(parts)
            bins, offsets, fills = best_fit(table["length"].to_numpy(), capacity)
            first = TaskContext.get().partitionId() << 32
            for name, x in (("bin", bins + first), ("offset", offsets), ("fill", fills[bins])):
                table = table.append_column(name, pa.array(x, pa.int64()))
            yield from table.to_batches(50_000)

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def handed_up(fills: np.ndarray, capacity: int, nearly_full: int, levels: int) -> np.ndarray:
    """Which bins of a group go to the next round, of so many to come: those up to half full, and the emptiest of the others."""
    up = fills <= capacity // 2
    rest = np.flatnonzero(~up & (fills < nearly_full))
    up[rest[np.argsort(fills[rest], kind="stable")[: FAN_IN * levels]]] = True
    return up


def merge_round(items: DataFrame, capacity: int, nearly_full: int, shift: int, levels: int) -> DataFrame:
    """One round over bins as items (bin, fill): groups of 8**shift partitions pack theirs together; levels: rounds to come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        group, bins, fills = (table[c].to_numpy() for c in ("group", "bin", "fill"))
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            own = own[np.lexsort((bins[own], -fills[own]))]
            parent, offset, total = best_fit(fills[own], capacity)
            first = np.zeros(len(total), np.int64)
            first[parent[::-1]] = bins[own][::-1]  # a parent is called after its first bin
            up = handed_up(total, capacity, nearly_full, levels)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bins[own], first[parent], offset, total[parent], up[parent])], ["bin", "parent", "shift", "fill", "up"])

    items = items.select(F.shiftright("bin", 32 + 3 * shift).alias("group"), "bin", "fill")
    return items.repartition("group").mapInArrow(run, MERGES)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int | None = 0, nearly_full: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every whole text in sequences of up to capacity tokens.

    path: a tokenizer file whose pieces hold no white space.  A document's ids and
    end_id make one piece, or, if longer than capacity, pieces of that size and a
    rest.  Null and empty texts have end_id alone (no piece where there is none).
    Rows that share a doc_id are separate documents.  An empty table gives no rows.  A very
    long text is encoded whole and cut into as many pieces as it takes.
    nearly_full: bins with as many tokens stay as they are, by default 63 of 64 parts of
    capacity; the tokens that such bins lack are all that this can cost.
    """
    nearly_full = nearly_full or capacity - capacity // 64
    pieces = stored(pack_local(docs, path, capacity, end_id, id_col, text_col), "pieces")
    bins = pieces.where("offset = 0").select("bin", "fill")
    last = bins.agg(F.max(F.shiftright("bin", 32))).first()[0] or 0
    levels = -(-int(last).bit_length() // 3)
    moves, items = None, bins.where(F.col("fill") < nearly_full)
    for shift in range(levels + 1):
        done = stored(merge_round(items, capacity, nearly_full, shift, levels - shift), "merges")
        step = done.select("bin", F.col("parent").alias("new"), F.col("shift").alias("more"))
        if moves is None:
            moves = done.where("bin != parent").select("bin", "parent", "shift")
        else:
            both = moves.join(step.withColumnRenamed("bin", "parent"), "parent", "left").select("bin", F.coalesce("new", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            moves = both.unionByName(done.where("bin != parent").select("bin", "parent", "shift"))
        items = done.where("up and shift = 0 and bin = parent").select("bin", "fill")
    return pieces.join(moves, "bin", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
