"""What the operators of this folder share: written tables, and texts as flat byte arrays.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return.  Their 64-bit hashes are polynomials over the
bytes, taken for a whole chunk of texts at once from one cumulative sum.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import is_local

#: Bytes of text that are worked on at once.
CHUNK_BYTES = 1 << 20
#: The same where the units of texts are counted, most of which come again.
UNITS_BYTES = 4 << 20
U64 = np.uint64


# --- written tables -------------------------------------------------------


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset, as in tests, an own one, which needs a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the program ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        context = spark.sparkContext
        if context._jsc is not None:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)

    atexit.register(remove)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and no lost executor takes it along."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage, on which Spark removes the shuffle files of queries that are done."""
    for _ in range(2):
        gc.collect()  # what Python still points to isn't garbage there
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)  # the cleaner works beside


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that are needed, under fixed names; others can be called as they like."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def fold(column: str | Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts))


# --- texts as bytes -------------------------------------------------------


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins (one more entry than texts).  Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, at = flat(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def distinct(data: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct ones among all data[cuts[k]:cuts[k + 1]], and the number of each among them."""
    where = pa.py_buffer(np.ascontiguousarray(cuts, np.int64))
    coded = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, where, pa.py_buffer(data)]).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


class Sums:
    """Counts by keys, summed up within a task; tables of partial sums leave it when there are too many keys."""

    def __init__(self, keys: list[str], value: str, limit: int = 200_000):
        self.keys, self.value, self.limit = keys, value, limit
        self.parts: list[pa.Table] = []
        self.rows = 0

    def _summed(self) -> pa.Table:
        found = pa.concat_tables(self.parts).group_by(self.keys).aggregate([(self.value, "sum")])
        return found.rename_columns([*self.keys, self.value]) if found.column_names[0] == self.keys[0] else found.rename_columns([self.value, *self.keys]).select([*self.keys, self.value])

    def add(self, part: pa.Table) -> Iterator[pa.RecordBatch]:
        """Yields what leaves the task."""
        self.parts.append(part.select([*self.keys, self.value]))
        self.rows += part.num_rows
        if self.rows > 2 * self.limit:
            self.parts = [self._summed()]
            self.rows = self.parts[0].num_rows
            if self.rows > self.limit:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from self._summed().combine_chunks().to_batches(max_chunksize=50_000)
        self.parts, self.rows = [], 0
        pa.default_memory_pool().release_unused()


class Lists:
    """A list of numbers for each distinct byte string, kept from chunk to chunk.

    find gives new strings' lists, all in one array, and how long each is.  Beyond
    limit strings, those that the chunk at hand has not are let go, so that
    frequent ones stay whatever came first.  Strings longer than LONG bytes are not kept.
    """

    LONG = 64

    def __init__(self, find: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 500_000, dtype: type = np.int32):
        self.find, self.limit = find, limit
        self.slot: dict[bytes, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)
        self.lists = self.numbers = 0

    def _append(self, numbers: np.ndarray, size: np.ndarray) -> np.ndarray:
        ends = self.numbers + np.cumsum(size)
        for name, used, more in (("start", self.lists, ends - size), ("size", self.lists, size), ("flat", self.numbers, numbers)):
            old = getattr(self, name)
            if used + len(more) > len(old):
                grown = np.zeros(max(1024, used + len(more), len(old) * 3 // 2), old.dtype)
                grown[:used] = old[:used]
                setattr(self, name, grown)
            getattr(self, name)[used : used + len(more)] = more
        self.lists, self.numbers = self.lists + len(size), self.numbers + len(numbers)
        return np.arange(self.lists - len(size), self.lists)

    def _gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[slots]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[slots] - ends + size, size) + np.arange(size.sum())], size

    def _only(self, keys: list[bytes], slots: np.ndarray) -> None:
        """Lets go of all strings but the known ones among keys."""
        known = np.flatnonzero(slots >= 0)
        numbers, size = self._gathered(slots[known])
        self.lists = self.numbers = 0
        slots[known] = self._append(numbers, size)
        self.slot = {keys[k]: s for k, s in zip(known.tolist(), slots[known].tolist())}

    def __call__(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of all data[cuts[k]:cuts[k + 1]] in a row, and how long each is."""
        keys, codes = distinct(data, cuts)
        slots = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(slots < 0).tolist()
        short, long = [k for k in new if len(keys[k]) <= self.LONG], [k for k in new if len(keys[k]) > self.LONG]
        if len(self.slot) + len(short) > self.limit:
            self._only(keys, slots)
        if short:
            slots[short] = self._append(*self.find([keys[k] for k in short]))
            self.slot.update(zip([keys[k] for k in short], slots[short].tolist()))
        kept = self.lists, self.numbers
        if long:
            slots[long] = self._append(*self.find([keys[k] for k in long]))
        out = self._gathered(slots[codes])
        self.lists, self.numbers = kept
        return out


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


#: The code points with the Unicode property White_Space.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


#: What a unit begins with: white space after other characters, or a sign right after a letter.
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_SIGN[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes are of white space, in UTF-8."""
    out = WHITE[data]
    for text in (chr(c) for c in SPACES if c >= 0x80):
        bytes_ = text.encode()
        at = np.flatnonzero(data[: len(data) - len(bytes_) + 1] == bytes_[0])
        for k, b in enumerate(bytes_[1:], 1):
            at = at[data[at + k] == b]
        for k in range(len(bytes_)):
            out[at + k] = True
    return out


def unit_cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of several texts, and the end; at: where each text begins, and the end."""
    if not len(data):
        return np.zeros(1, np.int64)
    white = _white(data) if (data >= 0x80).any() else WHITE[data]
    begins = np.empty(len(data) + 1, bool)
    begins[1:-1] = white[1:] & ~white[:-1] | _LETTER[data[:-1]] & _SIGN[data[1:]]
    begins[at] = True
    return np.flatnonzero(begins)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mixed(np.arange(1, 257, dtype=U64))
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=U64)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they lie."""
    if not len(data):
        return mixed(np.zeros(len(starts), U64))
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    inside = (total[ends] - total[starts]) * down[np.minimum(starts, len(data) - 1)]
    return mixed(inside + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word."""
    return runs_of(~WHITE[data], at)


def runs_of(black: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of bytes that are marked; none crosses texts."""
    if not len(black):
        return (np.zeros(0, np.int64),) * 3
    before = np.empty(len(black), bool)
    before[0], before[1:] = True, ~black[:-1]
    before[at[:-1][at[:-1] < len(black)]] = True
    after = np.empty(len(black), bool)
    after[-1], after[:-1] = True, ~black[1:]
    after[at[1:][at[1:] > 0] - 1] = True
    starts = np.flatnonzero(black & before)
    return starts, np.flatnonzero(black & after) + 1, np.searchsorted(at, starts, side="right") - 1


def windows(words: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every window of so many words, and the index of its first word; none crosses texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first = np.flatnonzero(text[:n] == text[size - 1 :])
    total = np.zeros(n, U64)
    for k in range(size):
        total = (total + words[k : k + n]) * U64(0xA0761D6478BD642F)
        total ^= total >> U64(29)
    return mixed(total[first]), first


def shingle_sets(texts: pa.Array, size: int, lower: bool = True) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A shingle is so many words in a row.  A text with fewer words, but one at
    least, has its whole sequence as the only shingle; one without words has none.
    """
    data, at = flat(texts)
    if lower:
        data = LOWER[data]
    starts, ends, text = word_spans(data, at)
    words = span_hashes(data, starts, ends)
    hashes, first = windows(words, text, size)
    word_at = np.searchsorted(text, np.arange(len(at)), side="left")
    shingle_at = np.searchsorted(text[first], np.arange(len(at)), side="left")
    out = []
    for k in range(len(at) - 1):
        n = word_at[k + 1] - word_at[k]
        if n >= size:
            out.append(np.unique(hashes[shingle_at[k] : shingle_at[k + 1]]))
        elif n:
            out.append(windows(words[word_at[k] : word_at[k + 1]], np.zeros(n, int), n)[0] ^ U64(n))
        else:
            out.append(np.zeros(0, U64))
    return out
