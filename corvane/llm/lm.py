"""Scores of texts by a trigram model with deleted interpolation.

Of the training documents one fold is deleted from the counts while the mixture
weights are learned: expectation-maximisation fits them to that fold's n-grams, a
weight for each order and each bucket of context frequency.  The model then takes
the counts of all training documents with these weights.

No table of n-grams is held as a whole anywhere.  Texts are coded once, in blocks of
a few MB with a vocabulary of their own.  A block asks for its distinct words, pairs
and triples, each once; what is asked is dealt by hash to buckets of a set size, which
sum the counts of all blocks and answer each of them in the order it asked.  A frequent
n-gram is asked for once a block, so no bucket grows with it.  Words are told apart by
their text and n-grams by the numbers of their words, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, chunks, flat, ids_and_texts, let_go, mixed, span_hashes, stored, word_spans

#: Bytes of text in a block, and tokens in a bucket; on executors with more memory both can be larger, which makes fewer and larger answers.
BLOCK_BYTES, BUCKET_TOKENS = 4 << 20, 1_500_000
#: What a document's first words follow, and what ends it; no word is like these.
START, END = b" ", b""
#: Classes of documents: held out from training, deleted while weights are learned, and the rest of training.
TEST, DELETED, KEPT = 0, 1, 2
#: Words are distinguished by orders 0 (any word) to 3.
ORDERS = 4
#: Context buckets by binary logarithm of frequency: after a known pair, after a known word, and after neither.
BUCKETS, PAIR_SEEN = 129, 65
U64 = np.uint64


# --- numbers as bytes -------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0, of one length: each as narrow as it can be, bytes of equal weight together."""
    import zstandard

    n, body, widths = len(columns[0]), [], []
    for c in columns:
        top = int(c.max()) if n else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        widths.append(width)
        body.append(np.ascontiguousarray(c).astype(f"<u{width}").view(np.uint8).reshape(n, width).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(columns), n, *widths], np.int64).tobytes(), *body]))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    k, n = (int(x) for x in raw[:16].view(np.int64))
    at, out = 16 + 8 * k, []
    for width in raw[16:at].view(np.int64).tolist():
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(f"<u{width}").reshape(n).astype(np.int64))
        at += n * width
    return out


def _text(words: list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(words))


def _words(blob: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob).split(b"\n")


# --- blocks -----------------------------------------------------------------


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of START, START, the words and END of every text; tokens of each text (words and END); the words by code."""
    data, at = flat(texts)
    data = LOWER[data]
    starts, ends, text = word_spans(data, at)
    words: list[bytes] = []
    codes = np.zeros(0, np.int64)
    if len(starts):
        cuts = np.column_stack([starts, ends]).ravel()  # words, and between them white space
        where = pa.py_buffer(np.ascontiguousarray(cuts, np.int64))
        found = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, where, pa.py_buffer(data)]).dictionary_encode()
        used, codes, times = np.unique(found.indices.to_numpy()[::2], return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent words have small codes, which pack better
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        codes = place[codes]
        words = found.dictionary.take(pa.array(used[order])).to_pylist()
    size = np.bincount(text, minlength=len(at) - 1)
    first = np.cumsum(size + 3) - size - 3
    out = np.full(int((size + 3).sum()), len(words), np.int64)
    out[np.arange(len(codes)) + 3 * text + 2] = codes
    out[first + size + 2] = len(words) + 1
    return out, size + 1, [*words, START, END]


def blocks(docs: DataFrame, folds: int = 10, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """block, cls, ids, sizes (tokens), codes, words: whole documents of one class together, about block_bytes of text."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(KEPT))

    def row(parts: list[pa.RecordBatch], block: int, cls: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        codes, sizes, words = coded(t["text"])
        ids = t["doc_id"].to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([cls], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack(codes)]), pa.array([_text(words)])], ["block", "cls", "ids", "sizes", "codes", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[pa.RecordBatch]] = {c: [] for c in (TEST, DELETED, KEPT)}
        size = dict.fromkeys(waiting, 0)
        for batch in batches:
            for part in chunks(batch, limit=block_bytes):
                for cls in waiting:
                    mine = part.filter(pc.equal(part.column("cls"), cls))
                    waiting[cls].append(mine)
                    size[cls] += mine.nbytes
                    if size[cls] >= block_bytes:
                        yield row(waiting[cls], block, cls)
                        block, waiting[cls], size[cls] = block + 1, [], 0
        for cls, parts in waiting.items():
            if any(p.num_rows for p in parts):
                yield row(parts, block, cls)
                block += 1

    texts = ids_and_texts(docs, id_col, text_col).withColumn("cls", F.least(fold, F.lit(KEPT)).cast("int"))
    return texts.mapInArrow(run, "block long, cls int, ids array<long>, sizes array<int>, codes binary, words binary")


# --- asking and answering ---------------------------------------------------


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a block asks, by bucket, and where each bucket begins in it (and the end)."""
    bucket = (hashes % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size)
    return span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)


def _gram_hashes(columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]), len(columns), U64)
    for c in columns:
        out = mixed(out * U64(0xA0761D6478BD642F) + c.astype(U64))
    return out


_ASKED = "n int, bucket int, block long, cls int, keys binary, times binary"
_ANSWERED = "n int, bucket int, block long, counts binary, known long"


def _asked_words(table: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, (codes,) = _words(r["words"]), unpack(r["codes"])
                times = np.bincount(codes, minlength=len(words))
                times[len(words) - 2] -= len(r["sizes"])  # of a document's two starts one counts
                order, at = _dealt(_word_hashes(words), buckets)
                out = [(1, k, r["block"], r["cls"], _text([words[j] for j in order[at[k] : at[k + 1]].tolist()]), pack(times[order[at[k] : at[k + 1]]])) for k in range(buckets) if at[k + 1] > at[k]]
                yield _batch(out, _ASKED)

    return table.select("block", "cls", "sizes", "codes", "words").mapInArrow(run, _ASKED)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _counted(code: np.ndarray, times: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By code, how often among kept and among deleted documents."""
    n = int(code.max()) + 1 if len(code) else 0
    return tuple(np.bincount(code, times * (cls == c), n).astype(np.int64) for c in (KEPT, DELETED))


def _answers_words(buckets: int):
    def run(asked: pa.Table) -> pa.Table:
        """Numbers and counts of a bucket's words, and one row more: how many of them are known."""
        rows = asked.to_pylist()
        words = [_words(r["keys"]) for r in rows]
        size = np.array([len(w) for w in words])
        all_words = pa.chunked_array([pa.array(w, pa.large_binary()) for w in words]).combine_chunks().dictionary_encode()
        code = all_words.indices.to_numpy().astype(np.int64)
        times = np.concatenate([unpack(r["times"])[0] for r in rows])
        kept, deleted = _counted(code, times, np.repeat([r["cls"] for r in rows], size))
        known = int((kept + deleted > 0).sum())
        if (start := pc.index(all_words.dictionary, pa.scalar(START, pa.large_binary())).as_py()) >= 0:
            known -= int(kept[start] + deleted[start] > 0)
        bucket, at = rows[0]["bucket"], np.append(0, np.cumsum(size))
        place = np.empty(len(kept), np.int64)
        place[np.argsort(-np.bincount(code, times), kind="stable")] = np.arange(len(kept))
        code = place[code]  # frequent words have small numbers, which pack better
        kept, deleted = (np.bincount(place, c, len(place)).astype(np.int64) for c in (kept, deleted))
        out = [(1, bucket, r["block"], pack(c * buckets + bucket, kept[c], deleted[c]), 0) for r, c in ((r, code[a:b]) for r, a, b in zip(rows, at, at[1:]))]
        return pa.Table.from_batches([_batch([*out, (1, bucket, -1, None, known)], _ANSWERED)])

    return run


def _answers_grams(asked: pa.Table) -> pa.Table:
    """Counts of a bucket's n-grams."""
    rows = asked.to_pylist()
    parts = [unpack(r["keys"]) for r in rows]
    columns = [np.concatenate([np.cumsum(p[0]) if k == 0 else p[k] for p in parts]) for k in range(len(parts[0]))]
    _, first, code = np.unique(_gram_hashes(columns), return_index=True, return_inverse=True)
    if any((c != c[first][code]).any() for c in columns):  # two n-grams with one hash
        code = np.unique(np.column_stack(columns), axis=0, return_inverse=True)[1].reshape(-1)
    size = np.array([len(p[0]) for p in parts])
    kept, deleted = _counted(code, np.concatenate([unpack(r["times"])[0] for r in rows]), np.repeat([r["cls"] for r in rows], size))
    at = np.append(0, np.cumsum(size))
    out = [(r["n"], r["bucket"], r["block"], pack(kept[code[a:b]], deleted[code[a:b]]), 0) for r, a, b in zip(rows, at, at[1:])]
    return pa.Table.from_batches([_batch(out, _ANSWERED)])


@dataclass
class _Block:
    """One block's n-grams, and what it was answered."""

    ids: list[int | None]
    sizes: np.ndarray
    codes: np.ndarray  # words by their numbers' order
    numbers: np.ndarray
    token: np.ndarray  # places of tokens in codes
    pair: np.ndarray  # at each place the pair that ends there
    pairs: list[np.ndarray]  # distinct ones, as codes
    pair_times: np.ndarray
    triple: np.ndarray  # of each token
    triples: list[np.ndarray]
    triple_times: np.ndarray
    word_counts: list[np.ndarray]  # kept, deleted

    @classmethod
    def of(cls, block: dict, answers: list[dict], buckets: int) -> _Block:
        words, (codes,) = _words(block["words"]), unpack(block["codes"])
        order, _ = _dealt(_word_hashes(words), buckets)
        said = _in_order(answers, 1, order)
        rank = np.argsort(said[0])  # from here on codes are by number, so that n-grams are sorted
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        codes, n = place[codes], len(rank)
        sizes = np.array(block["sizes"], np.int64)
        first = np.cumsum(sizes + 2) - sizes - 2
        inside = np.ones(len(codes), bool)
        inside[first] = False
        pair, ends = np.zeros(len(codes), np.int64), np.flatnonzero(inside)
        keys, pair[ends], pair_times = np.unique(codes[ends - 1] * n + codes[ends], return_inverse=True, return_counts=True)
        pairs = [keys // n, keys % n]
        inside[first + 1] = False
        token = np.flatnonzero(inside)
        keys, triple, triple_times = np.unique(pair[token - 1] * n + codes[token], return_inverse=True, return_counts=True)
        triples = [pairs[0][keys // n], pairs[1][keys // n], keys % n]
        return cls(block["ids"], sizes, codes, said[0][rank], token, pair, pairs, pair_times, triple, triples, triple_times, [c[rank] for c in said[1:]])

    def dealt(self, n: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words of its distinct n-grams, how often each is there, the order of asking, and where buckets begin."""
        columns = [self.numbers[c] for c in (self.pairs if n == 2 else self.triples)]
        return columns, self.pair_times if n == 2 else self.triple_times, *_dealt(_gram_hashes(columns), buckets)

    def answered(self, answers: list[dict], n: int, buckets: int) -> list[np.ndarray]:
        return _in_order(answers, n, self.dealt(n, buckets)[2])


def _in_order(answers: list[dict], n: int, order: np.ndarray) -> list[np.ndarray]:
    """The columns of the answers about n-grams, each n-gram at its place in the block."""
    parts = [unpack(r["counts"]) for r in sorted((r for r in answers if r["n"] == n), key=lambda r: r["bucket"])]
    out = []
    for column in zip(*parts):
        values = np.empty(len(order), np.int64)
        values[order] = np.concatenate(column)
        out.append(values)
    return out


def _asked_grams(buckets: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows, said = block.to_pylist(), answers.to_pylist()
        out = []
        for r in rows:
            own = _Block.of(r, said, buckets)
            for n in (2, 3):
                columns, times, order, at = own.dealt(n, buckets)
                for k in range(buckets):
                    mine = order[at[k] : at[k + 1]]
                    if len(mine):
                        out.append((n, k, r["block"], r["cls"], pack(np.diff(columns[0][mine], prepend=0), *(c[mine] for c in columns[1:])), pack(times[mine])))
        return pa.Table.from_batches([_batch(out, _ASKED)])

    return run


# --- the model --------------------------------------------------------------


def context_bucket(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    """By how often the two words before were seen as a pair, else how often the one before was, else 0."""
    log = lambda c: np.frexp(np.maximum(c, 1).astype(np.float64))[1] - 1  # noqa: E731  of whole numbers
    return np.where(pair > 0, PAIR_SEEN + log(pair), np.where(word > 0, 1 + log(word), 0))


def estimates(c1: np.ndarray, c2: np.ndarray, word: np.ndarray, c3: np.ndarray, pair: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """Rows of maximum-likelihood estimates of orders 0 to 3; word and pair: counts of the contexts."""
    return np.column_stack([np.full(len(c1), 1 / (kinds + 1)), c1 / max(total, 1), c2 / np.maximum(word, 1), c3 / np.maximum(pair, 1)])


@dataclass(frozen=True)
class Interpolation:
    """total: training tokens; kinds: distinct ones; weights: by context bucket, of orders 0 to 3."""

    total: int
    kinds: int
    weights: np.ndarray


def _usable(total: int) -> np.ndarray:
    """Which orders have estimates in each context bucket."""
    bucket = np.arange(BUCKETS)[:, None]
    return np.concatenate([bucket >= 0, (bucket >= 0) & (total > 0), bucket > 0, bucket >= PAIR_SEEN], axis=1)


def mixture(expected: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Weights from expected counts by bucket and order, with one more of each usable order, so that order 0 keeps a share."""
    found = np.where(usable, expected + 1.0, 0.0)
    return found / found.sum(1, keepdims=True)


def _learned(rows: DataFrame, total: int, kinds: int, rounds: int) -> np.ndarray:
    """Weights by expectation-maximisation over rows (grams: packed times, c1, c2, word, c3, pair)."""
    usable = _usable(total)
    weights = mixture(np.zeros((BUCKETS, ORDERS)), usable)
    schema = "bucket int, " + ", ".join(f"r{k} double" for k in range(ORDERS))

    def step(weights: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((BUCKETS, ORDERS))
            for batch in batches:
                for blob in batch.column("grams").to_pylist():
                    times, c1, c2, word, c3, pair = unpack(blob)
                    bucket = context_bucket(pair, word)
                    p = weights[bucket] * estimates(c1, c2, word, c3, pair, total, kinds)
                    p *= (times / p.sum(1))[:, None]
                    for k in range(ORDERS):
                        sums[:, k] += np.bincount(bucket, p[:, k], BUCKETS)
            yield _batch([(k, *sums[k].tolist()) for k in np.flatnonzero(sums.any(1)).tolist()], schema)

        found = rows.mapInArrow(run, schema).groupBy("bucket").agg(*(F.sum(f"r{k}").alias(f"r{k}") for k in range(ORDERS))).collect()  # BUCKETS rows at most
        out = np.zeros((BUCKETS, ORDERS))
        for r in found:
            out[r["bucket"]] = [r[f"r{k}"] for k in range(ORDERS)]
        return out

    for _ in range(rounds):
        weights = mixture(step(weights), usable)
    return weights


class Counted:
    """Blocks of documents, answered: what fit() and scores() need."""

    def __init__(self, docs: DataFrame, folds: int = 10, block_bytes: int = BLOCK_BYTES, bucket_tokens: int = BUCKET_TOKENS, id_col: str = "doc_id", text_col: str = "text"):
        self.blocks = stored(blocks(docs, folds, block_bytes, id_col, text_col), "blocks")
        totals = {r["cls"]: r["n"] for r in self.blocks.groupBy("cls").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}
        self.kept, self.total = totals.get(KEPT, 0), totals.get(KEPT, 0) + totals.get(DELETED, 0)
        self.buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-sum(totals.values()) // bucket_tokens))
        words = stored(_asked_words(self.blocks, self.buckets).groupBy("bucket").applyInArrow(_answers_words(self.buckets), _ANSWERED), "words")
        self.kinds = words.agg(F.sum("known").alias("n")).first()["n"] or 0
        words = words.where("block >= 0")
        let_go(docs.sparkSession)
        asked = self.blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_asked_grams(self.buckets), _ASKED)
        self.answers = words.unionByName(stored(asked.groupBy("n", "bucket").applyInArrow(_answers_grams, _ANSWERED), "grams"))
        let_go(docs.sparkSession)

    def _each(self, table: DataFrame, run, schema: str) -> DataFrame:
        return table.groupBy("block").cogroup(self.answers.join(table.select("block"), "block", "left_semi").groupBy("block")).applyInArrow(run, schema)

    def fit(self, rounds: int = 12) -> Interpolation:
        """Weights from the deleted documents' n-grams, estimates being of the kept ones' counts."""
        buckets = self.buckets

        def grams(block: pa.Table, answers: pa.Table) -> pa.Table:
            said, out = answers.to_pylist(), []
            for r in block.to_pylist():
                own = _Block.of(r, said, buckets)
                pairs, triples = own.answered(said, 2, buckets)[0], own.answered(said, 3, buckets)[0]
                place = own.token[np.unique(own.triple, return_index=True)[1]]  # one of each triple
                words = own.word_counts[0]
                out.append((pack(own.triple_times, words[own.codes[place]], pairs[own.pair[place]], words[own.codes[place - 1]], triples, pairs[own.pair[place - 1]]),))
            return pa.Table.from_batches([_batch(out, "grams binary")])

        rows = stored(self._each(self.blocks.where(F.col("cls") == DELETED), grams, "grams binary"), "deleted")
        return Interpolation(self.total, self.kinds, _learned(rows, self.kept, self.kinds, rounds))

    def scores(self, model: Interpolation) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
        buckets, base = self.buckets, np.log10(model.total + 0.1 * (model.kinds + 1))
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

        def run(block: pa.Table, answers: pa.Table) -> pa.Table:
            said, out = answers.to_pylist(), []
            for r in block.to_pylist():
                own = _Block.of(r, said, buckets)
                words, pairs, triples = (sum(c) for c in (own.word_counts, own.answered(said, 2, buckets), own.answered(said, 3, buckets)))
                at = own.token
                c1, word, pair = words[own.codes[at]], words[own.codes[at - 1]], pairs[own.pair[at - 1]]
                p = (model.weights[context_bucket(pair, word)] * estimates(c1, pairs[own.pair[at]], word, triples[own.triple], pair, model.total, model.kinds)).sum(1)
                starts = np.cumsum(own.sizes) - own.sizes
                summed = [np.add.reduceat(x, starts).tolist() for x in ((c1 > 0).astype(np.int64), np.log10(c1 + 0.1) - base, np.log10(p))]
                out += [(i, r["cls"] == TEST, n, k, model.total, b, s) for i, n, k, b, s in zip(own.ids, own.sizes.tolist(), *summed)]
            return pa.Table.from_batches([_batch(out, schema)])

        return self._each(self.blocks, run, schema)


def score(docs: DataFrame, folds: int = 10, rounds: int = 12, block_bytes: int = BLOCK_BYTES, bucket_tokens: int = BUCKET_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row in.

    Tokens are words in lower case (A to Z), and one end a document.  Documents whose
    CRC-32 of the id as text leaves 0 when divided by folds are held out: they are scored,
    but nothing is learned from them.  Of the others those that leave 1 are deleted while
    the weights are learned.  A null id counts as one of the rest.  base_score is by single
    words with 0.1 added to each count, score by the interpolated trigrams.

    Null and empty texts are of one token, the end.  Repeated rows count as often as they
    are there.  A document is in one block whole, however long.  Without training
    documents every token has probability 1, that of the one unknown word; no rows give
    none.  Other columns are not looked at.
    """
    counted = Counted(docs, folds, block_bytes, bucket_tokens, id_col, text_col)
    return counted.scores(counted.fit(rounds))
