"""Byte-level BPE: encoding whole texts to token ids, and decoding ids to bytes.

Every code point has a class, kept in one array.  A small automaton over these
classes says where a piece begins.  Its transition functions are elements of a
finite monoid; blocks of a text are reduced in step by products from the
monoid's table, the blocks' products are scanned associatively, and a last step
gives each code point the state before it.  No regex is run.  The pieces between
boundaries are numbered by their distinct strings and looked up in a cache; new
ones are merged together in numpy.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Lists, chunks, flat, ids_and_texts

#: Classes of code points: letter, number, other, white space, and a blank or an
#: apostrophe that starts a longer piece; WHITE_LAST is white space before a black character.
LETTER, NUMBER, OTHER, WHITE, WHITE_LAST, BLANK, SHORT_1, SHORT_2, START = range(9)
#: States: what the piece at hand consists of; AFTER_* wait for the letters of a short
#: form, and after the last one, DONE, whatever follows begins a piece.
S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_BLANK, S_AFTER_1, S_AFTER_2, S_DONE = STATES = range(8)
#: Bytes of text whose pieces are looked up at once.
PIECES_BYTES = 2 << 20
#: Longer pieces are merged one by one, with a heap.
LONG_PIECE = 200
BLOCK = 128


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """step[state, class] and, beside it, whether a piece begins there."""
    step, begins = np.zeros((len(STATES), 9), np.uint8), np.zeros((len(STATES), 9), bool)
    plain = {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER}
    for state in STATES:
        for kind, same in plain.items():
            step[state, kind], begins[state, kind] = same, state not in (same, S_BLANK)
        step[state, WHITE], begins[state, WHITE] = S_WHITE, state != S_WHITE
        step[state, WHITE_LAST], begins[state, WHITE_LAST] = S_WHITE, True
        step[state, BLANK], begins[state, BLANK] = S_BLANK, True
        joined = state in (S_OTHER, S_BLANK)
        step[state, SHORT_1], begins[state, SHORT_1] = S_OTHER if joined else S_AFTER_1, not joined
        step[state, SHORT_2], begins[state, SHORT_2] = S_OTHER if joined else S_AFTER_2, not joined
        step[state, START] = S_WHITE
    # the letters of a short form belong to it
    step[S_AFTER_2, LETTER], begins[S_AFTER_2, LETTER] = S_AFTER_1, False
    step[S_AFTER_1, LETTER], begins[S_AFTER_1, LETTER] = S_DONE, False
    return step, begins


def monoid(step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of an automaton's transition functions.

    Returns the functions (element, state), the element of each class, and the
    table of products: product[a, b] is first a, then b.
    """
    functions = [tuple(range(len(step)))]
    index = {functions[0]: 0}
    letters = [tuple(int(x) for x in step[:, c]) for c in range(step.shape[1])]
    for f in functions:
        for g in letters:
            if (h := tuple(g[x] for x in f)) not in index:
                index[h] = len(functions)
                functions.append(h)
    product = np.array([[index[tuple(g[x] for x in f)] for g in functions] for f in functions], np.int32)
    return np.array(functions, np.int32), np.array([index[g] for g in letters], np.int32), product


def states_before(classes: np.ndarray, step: np.ndarray, parts: tuple, first_state: int) -> np.ndarray:
    """The state before each symbol, by a blocked associative scan."""
    functions, element, product = parts
    n = len(classes)
    rows = -(-n // BLOCK)
    size = len(functions)
    grid = np.zeros(rows * BLOCK, np.int32)
    grid[:n] = element[classes]
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    whole, table = grid[0].copy(), product.ravel()
    for k in range(1, BLOCK):
        whole = table[whole * size + grid[k]]
    reach = 1
    while reach < rows:  # inclusive scan over the blocks
        whole[reach:] = table[whole[:-reach] * size + whole[reach:]]
        reach *= 2
    state = np.full(rows, first_state, np.int32)
    state[1:] = functions[whole[:-1], first_state]
    out = np.empty((BLOCK, rows), np.uint8)
    classes = np.concatenate([classes, np.zeros(rows * BLOCK - n, classes.dtype)]).reshape(rows, BLOCK).T
    flat_step, width = step.ravel().astype(np.int32), step.shape[1]
    for k in range(BLOCK):
        out[k] = state
        state = flat_step[state * width + classes[k]]
    return out.T.ravel()[:n]


@lru_cache(1)
def _code_points() -> np.ndarray:
    """The class of every code point, by its Unicode category."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    # fixed values: code points with the Unicode property White_Space
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    return out


@lru_cache(1)
def _scanner() -> tuple:
    step, begins = _automaton()
    return step, begins, monoid(step)


def piece_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces begin among the code points of several texts; at: where each text begins, and the end.

    Each text is led in by the class START, which resets the automaton.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _code_points()[points]
    first = np.zeros(n + 1, bool)
    first[at] = True
    white = kind == WHITE
    follows = np.zeros(n, bool)  # a black character of the same text follows
    follows[:-1] = ~white[1:] & ~first[1:n]
    kind[white & follows] = WHITE_LAST
    kind[(points == 0x20) & follows] = BLANK
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        near = np.zeros((3, len(quotes)), np.uint32)
        inside = np.ones(len(quotes), bool)
        for k in (1, 2):
            there = np.minimum(quotes + k, n - 1)
            inside &= (quotes + k < n) & ~first[there]
            near[k] = np.where(inside, points[there], 0)
        one = np.isin(near[1], [ord(c) for c in "stmd"])
        two = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (near[1] == ord(a)) & (near[2] == ord(b))
        kind[quotes[one]], kind[quotes[two]] = SHORT_1, SHORT_2
    # the START symbols go between the texts
    full = at[:-1][np.diff(at) > 0]
    place = np.arange(n) + np.cumsum(first[:n])
    symbols = np.full(n + len(full), START, np.uint8)
    symbols[place] = kind
    step, begins, parts = _scanner()
    state = states_before(symbols, step, parts, S_WHITE)[place]
    new = begins[state, kind]
    new[full] = True
    return np.flatnonzero(new)


class Vocabulary:
    """The merges of a rank file: a line has a token in base 64 and its rank, which is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.token = [b""] * (max(self.ids.values()) + 1)
        for token, k in self.ids.items():
            self.token[k] = token
        self.tokens = pa.array(self.token, pa.large_binary())
        self.lengths = np.array([len(x) for x in self.token], np.int64)
        self.bytes = np.array([self.ids[bytes([k])] for k in range(256)], np.int64)
        self.size = len(self.token)
        pairs = {}
        for token, k in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = k
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pieces = Lists(self._found)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; size where there is none."""
        key = left * self.size + right
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.merged[k], self.size)

    def _found(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.merge_all(pieces)
        return np.frombuffer(b"".join(ids), "<i4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit numbers; in each round every piece merges its best pair."""
        out: list[bytes | None] = [None] * len(pieces)
        open_, long = [], []
        for k, piece in enumerate(pieces):
            if (whole := self.ids.get(piece)) is not None:
                out[k] = whole.to_bytes(4, "little")
            else:
                (long if len(piece) > LONG_PIECE else open_).append(k)
        for k in long:
            out[k] = self.merge_long(pieces[k])
        if open_:
            sizes = np.array([len(pieces[k]) for k in open_])
            ids = self.bytes[np.frombuffer(b"".join(pieces[k] for k in open_), np.uint8)]
            owner = np.repeat(np.arange(len(open_)), sizes)
            done_ids, done_owner = [], []
            while len(ids):
                rank = np.full(len(ids), self.size, np.int64)
                rank[:-1] = self._ranks(ids[:-1], ids[1:])
                rank[:-1][owner[:-1] != owner[1:]] = self.size
                begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                size = np.diff(np.append(begin, len(ids)))
                best = np.repeat(np.minimum.reduceat(rank, begin), size)
                over = best == self.size
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                hit = np.flatnonzero((rank == best) & ~over)
                if not len(hit):
                    break
                hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]  # the leftmost of each piece
                ids = ids.copy()
                ids[hit] = rank[hit]
                keep = ~over
                keep[hit + 1] = False
                ids, owner = ids[keep], owner[keep]
            ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
            ids = ids[np.argsort(owner, kind="stable")].astype("<u4")
            ends = np.cumsum(np.bincount(owner, minlength=len(open_))) * 4
            data, begin = ids.tobytes(), 0
            for k, end in zip(open_, ends.tolist()):
                out[k], begin = data[begin:end], end
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one long piece, in n log n steps."""
        ids: list[int] = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, k) for k in range(n - 1) if (r := self.pairs.get(ids[k] * self.size + ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k] if alive[k] else -1
            if j < 0 or self.pairs.get(ids[k] * self.size + ids[j]) != rank:
                continue
            ids[k], alive[j], after[k] = rank, False, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] >= 0 and (r := self.pairs.get(ids[a] * self.size + ids[after[a]])) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([x for x, here in zip(ids, alive) if here], "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Lists of ids, and of the place in the text's bytes where each token ends."""
        data, at = flat(texts)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
        byte_at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=byte_at[1:])
        starts = piece_starts(points, np.searchsorted(byte_at, at))
        cuts = np.append(byte_at[starts], len(data))
        tokens, size = self.pieces(data, cuts)
        lists = np.append(0, np.cumsum(size))[np.searchsorted(cuts, at)]
        ends = np.cumsum(self.lengths[tokens])
        ends -= np.repeat(at[:-1], np.diff(lists))
        return tuple(pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(x, pa.int32())) for x in (tokens, ends))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; a null list gives none."""
        ids = ids.fill_null([])
        at = ids.offsets.to_numpy()
        tokens = self.tokens.take(ids.values.slice(at[0], at[-1] - at[0]))
        if not len(tokens):
            return pa.array([b""] * len(ids), pa.large_binary())
        _, ends, data = tokens.buffers()
        ends = np.frombuffer(ends, np.int64)[tokens.offset :][at - at[0]]
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), data])

    def checked(self, ids: pa.ListArray, ends: pa.ListArray) -> pa.Array:
        """The same, if the last token of each list ends where the bytes do."""
        out, ends = self.decode(ids), ends.fill_null([])
        at = ends.offsets.to_numpy()
        last = np.zeros(len(ends), np.int64)
        full = at[1:] > at[:-1]
        last[full] = ends.values.to_numpy()[at[1:][full] - 1]
        if (last != pc.binary_length(out).to_numpy()).any():
            raise ValueError("ids and offsets disagree")
        return out.cast(pa.binary())


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker and file."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, ends array<int>: the tokens of each whole text, and where each ends in its UTF-8 bytes.

    path: a rank file, installed on every executor.  One row out for each row in,
    repeated rows included.  A null or empty text has empty lists; a null id stays
    null; an empty table gives no rows.  A very long text is encoded whole, a piece of it
    at a time.  Other columns are neither read nor returned, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=PIECES_BYTES):
                ids, ends = vocabulary(path).encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, ends], ["doc_id", "ids", "ends"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and decoded binary: the bytes of ids, cut to where the last token ends.

    tokens: with ids and ends, as encode() returns them.  Fails if ids and ends disagree.
    """
    schema = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                decoded = vocabulary(path).checked(part.column("ids"), part.column("ends"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), decoded], [*keep, "decoded"])

    return tokens.select(*keep, "ids", "ends").mapInArrow(run, f"{schema}, decoded binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded binary: encode() and decode() in one step.

    One after the other they take two Python workers a task, and as idle workers
    serve either, every one of them comes to hold a vocabulary and its cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=PIECES_BYTES):
                ids, ends = vocabulary(path).encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, vocabulary(path).checked(ids, ends)], ["doc_id", "ids", "decoded"])
            pa.default_memory_pool().release_unused()

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return round_trip(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
