"""Hard negatives by vantage-point trees over norm-augmented vectors.

A coordinate more makes all vectors as long as the longest, M, so that products and
distances say the same: d(a, x)^2 = |a|^2 + M^2 - 2 * a.x for an anchor a, whose own
coordinate is 0.  The k rows of greatest product are the k nearest, and a window of
products is an annulus around the anchor.

A tree over a bounded sample deals all rows to cells, in whose order the index is
written.  A task builds trees over the rows that it reads and goes through a tree's
leaves from the nearest on, for all anchors of a block at once, until a leaf is beyond
the annulus or beyond the k best so far; what it finds narrows the search in the trees
that follow.  A leaf is compared in full, by a product of matrices of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import new_path, stored

#: Rows that the tree of cells is fitted on, and levels of that tree at most.
SAMPLE, CELL_LEVELS = 4096, 8
#: Rows that a task's tree is over, and rows in a leaf.
TREE_ROWS, LEAF_ROWS = 8192, 256
#: Bytes of anchors' vectors that a block has, and bytes of vectors that a part of the index has.
BLOCK_BYTES, PART_BYTES = 16 << 20, 128 << 20
#: Products below are exact as doubles; from LARGEST on they would leave 64 bits.
EXACT, LARGEST = 2**53, 2**61
NONE, ALL = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Tree:
    """Vantage points in heap order, and the least and greatest distance to each of what lies on either side of it.

    vantage: augmented vectors; bounds[node, side] = (least, greatest).
    """

    levels: int
    vantage: np.ndarray
    bounds: np.ndarray

    @classmethod
    def over(cls, rows: np.ndarray, levels: int) -> tuple[Tree, list[np.ndarray]]:
        """The tree over augmented rows, halved at each level, and the rows of each leaf."""
        vantage, bounds = np.zeros((2**levels - 1, rows.shape[1])), np.zeros((2**levels - 1, 2, 2))
        parts = [np.arange(len(rows))]
        for level in range(levels):
            below: list[np.ndarray] = []
            for k, mine in enumerate(parts):
                node = 2**level - 1 + k
                if not len(mine):
                    below += [mine, mine]
                    bounds[node] = (np.inf, -np.inf)
                    continue
                far = rows[mine[np.argmax(_distances(rows[mine], rows[mine[0]]))]]  # points at the edge part best
                d = _distances(rows[mine], far)
                order = np.argsort(d, kind="stable")
                half = (len(mine) + 1) // 2
                vantage[node] = far
                for side, some in enumerate((order[:half], order[half:])):
                    bounds[node, side] = (d[some].min(), d[some].max()) if len(some) else (np.inf, -np.inf)
                    below.append(mine[some])
            parts = below
        return cls(levels, vantage, bounds), parts

    def opened(self) -> Tree:
        """The same, with sides that hold every point there may be: up to the middle between both, or beyond it."""
        middle = (np.where(np.isfinite(self.bounds[:, 0, 1]), self.bounds[:, 0, 1], 0.0) + np.where(np.isfinite(self.bounds[:, 1, 0]), self.bounds[:, 1, 0], self.bounds[:, 0, 1])) / 2
        middle = np.where(np.isfinite(middle), middle, 0.0)
        return Tree(self.levels, self.vantage, np.stack([np.stack([np.zeros_like(middle), middle], 1), np.stack([middle, np.full_like(middle, np.inf)], 1)], 1))

    def cell(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each augmented row, by an opened tree."""
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.levels):
            d = np.sqrt(((rows - self.vantage[node]) ** 2).sum(1))
            node = 2 * node + 1 + (d > self.bounds[node, 0, 1])
        return node - (2**self.levels - 1)

    def ring(self, anchors: np.ndarray, squares: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
        """For anchors x leaves, what distance a row of the leaf has at least and at most."""
        n = 2**self.levels
        least, most = np.zeros((len(anchors), n)), np.full((len(anchors), n), np.inf)
        apart = np.sqrt(np.maximum(squares[:, None] + longest - 2 * (anchors @ self.vantage[:, :-1].T), 0))
        for node in range(n - 1):
            level = (node + 1).bit_length() - 1
            width = n >> level
            first = (node + 1 - 2**level) * width
            d = apart[:, node, None]
            for side, at in enumerate((first, first + width // 2)):
                low, high = self.bounds[node, side]
                leaves = slice(at, at + width // 2)
                if low > high:  # nothing lies there
                    least[:, leaves], most[:, leaves] = np.inf, -np.inf
                    continue
                np.maximum(least[:, leaves], np.maximum(low - d, d - high), out=least[:, leaves])
                np.minimum(most[:, leaves], d + high, out=most[:, leaves])
        return least, most


def _distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - point) ** 2).sum(1))


def augmented(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Rows of doubles with the coordinate that makes their squares sum up to longest."""
    own = vectors.astype(np.float64)
    return np.column_stack([own, np.sqrt(np.maximum(longest - (own * own).sum(1), 0))])


@dataclass
class Asked:
    """A block of searches: each for rows of the anchor's label, or of all others, with a product from low to high."""

    key: np.ndarray
    row: np.ndarray  # the anchor's own, which is not found
    label: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int


class Nearest:
    """The k best of each search among all rows that add() was given: greater products first, then smaller ids."""

    def __init__(self, asked: Asked, longest: int):
        self.asked, self.longest = asked, float(longest)
        kind = np.float64 if longest < EXACT else np.int64
        self.vectors, self.kind = asked.vectors.astype(kind), kind
        self.doubles = asked.vectors.astype(np.float64)
        self.squares = (self.doubles**2).sum(1)
        self.room = 1e-6 * (1 + np.sqrt(self.longest))
        self.score = np.full((len(asked.key), asked.k), NONE)
        self.id = np.zeros((len(asked.key), asked.k), np.int64)

    def need(self) -> np.ndarray:
        """The least product that still counts; equal ones may, by their ids."""
        return np.maximum(self.asked.low, self.score[:, -1])

    def radius(self, product: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.squares + self.longest - 2 * product.astype(np.float64), 0))

    def reached(self, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        """Searches x leaves: which may hold what is asked for, and the least distance; with room for rounding."""
        least, most = tree.ring(self.doubles, self.squares, self.longest)
        inner = self.radius(self.asked.high)
        outer = np.where(self.need() <= self.asked.high, self.radius(self.need()), -np.inf)
        return (least <= (outer + self.room)[:, None]) & (most >= (inner - self.room)[:, None]), least

    def add(self, row: np.ndarray, id: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> None:
        if not len(row) or not len(self.asked.key) or not self.asked.k:
            return
        levels = max(0, int(np.ceil(np.log2(len(row) / LEAF_ROWS))))
        tree, leaves = Tree.over(augmented(vectors, self.longest), levels)
        own = vectors.astype(self.kind)
        possible, least = self.reached(tree)
        order = np.argsort(least, axis=1, kind="stable")
        every = np.arange(len(self.asked.key))
        for turn in range(order.shape[1]):  # every search's nearest leaf, then its next
            leaf = order[:, turn]
            open_ = np.flatnonzero(self._within(least[every, leaf]))
            if not len(open_):
                break  # all further leaves are farther
            open_ = open_[possible[open_, leaf[open_]]]
            by = open_[np.argsort(leaf[open_], kind="stable")]
            if not len(open_):
                continue
            names, starts = np.unique(leaf[by], return_index=True)
            for name, searches in zip(names.tolist(), np.split(by, starts[1:])):
                mine = leaves[name]
                if len(mine):
                    self._compare(searches, row[mine], id[mine], label[mine], own[mine])

    def _within(self, least: np.ndarray) -> np.ndarray:
        """Which searches still ask for what is so far away."""
        return (least <= self.radius(self.need()) + self.room) & (self.need() <= self.asked.high)

    def _compare(self, searches: np.ndarray, row: np.ndarray, id: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> None:
        a = self.asked
        product = self.vectors[searches] @ vectors.T
        alike = a.label[searches, None] == label
        fits = (product >= self.need()[searches, None]) & (product <= a.high[searches, None]) & (alike if a.same else ~alike) & (a.row[searches, None] != row)
        at, other = np.nonzero(fits)
        if not len(at):
            return
        changed = np.unique(at)
        mine = searches[changed]
        search = np.concatenate([searches[at], np.repeat(mine, a.k)])
        score = np.concatenate([product[at, other].astype(np.int64), self.score[mine].ravel()])
        ids = np.concatenate([id[other], self.id[mine].ravel()])
        order = np.lexsort((ids, ~score, search))
        search, score, ids = search[order], score[order], ids[order]
        place = np.arange(len(search)) - np.searchsorted(search, search)
        best = place < a.k
        self.score[search[best], place[best]], self.id[search[best], place[best]] = score[best], ids[best]

    def rows(self) -> Iterator[pa.RecordBatch]:
        search, place = np.nonzero(self.score > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(self.asked.key[search]), pa.array(self.id[search, place]), pa.array(self.score[search, place])], ["key", "id", "score"])


def _matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), dim)


class Index:
    """Rows (row, id, label, vector of dim whole numbers, anchor, cell) in the order of cells."""

    def __init__(self, rows: DataFrame, dim: int, n: int, longest: int, sample: int = SAMPLE, levels: int = CELL_LEVELS):
        self.dim, self.longest = dim, longest
        some = rows.select("vector").orderBy(F.xxhash64("id", "vector")).limit(sample).toArrow()  # bounded by sample
        drawn = augmented(_matrix(some["vector"], dim), longest)
        levels = max(0, min(levels, int(np.log2(max(1, len(drawn)) / 8))))
        self.tree = tree = Tree.over(drawn, levels)[0].opened()

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = tree.cell(augmented(_matrix(batch.column("vector"), dim), longest))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

        spark = rows.sparkSession
        parts = max(spark.sparkContext.defaultParallelism, -(-n * dim * 8 // PART_BYTES))
        dealt = rows.mapInArrow(placed, "id long, label long, vector array<long>, anchor boolean, cell int")
        # equal vectors share a cell, which the second key spreads
        spread = dealt.withColumn("salt", F.xxhash64("id")).repartitionByRange(parts, "cell", "salt").sortWithinPartitions("cell", "salt").drop("salt")
        self.rows = stored(spread.withColumn("row", F.monotonically_increasing_id()), "index")

    def anchors(self, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.Table]:
        """Blocks of anchors, those of near cells together; a large cell takes several."""
        most = max(1, block_bytes // (8 * max(1, self.dim)))
        counts = {r["cell"]: r["n"] for r in self.rows.where("anchor").groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        block: list[int] = []
        blocks: list[tuple[list[int], int]] = []
        for cell in sorted(counts):
            if block and sum(counts[c] for c in block) + counts[cell] > most:
                blocks.append((block, 1))
                block = []
            block.append(cell)
            if counts[cell] > most:
                blocks.append((block, -(-counts[cell] // most)))
                block = []
        for cells, parts in [*blocks, *([(block, 1)] if block else [])]:
            mine = self.rows.where(F.col("anchor") & F.col("cell").isin(cells))
            for k in range(parts):
                yield mine.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == k).toArrow()

    def search(self, asked: Asked, cells: list[int]) -> DataFrame:
        """key, id, score: the k best of every search among the rows of these cells."""
        dim, longest = self.dim, self.longest
        shared = self.rows.sparkSession.sparkContext.broadcast(asked)  # bounded by the block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, waiting, n = Nearest(shared.value, longest), [], 0

            def add() -> None:
                t = pa.Table.from_batches(waiting)
                found.add(t["row"].to_numpy(), t["id"].to_numpy(), t["label"].to_numpy(), _matrix(t["vector"], dim))

            for batch in batches:
                waiting.append(batch)
                n += batch.num_rows
                if n >= TREE_ROWS:
                    add()
                    waiting, n = [], 0
            if n:
                add()
            yield from found.rows()

        some = self.rows.where(F.col("cell").isin(cells)).select("row", "id", "label", "vector")
        every = some.mapInArrow(run, "key long, id long, score long")
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
        return every.withColumn("place", place).where(F.col("place") <= asked.k)

    def cells(self, asked: Asked) -> list[int]:
        """Cells that may hold what is asked for."""
        found = Nearest(asked, self.longest).reached(self.tree)[0]
        return np.flatnonzero(found.any(0)).tolist()


def mine(rows: DataFrame, id_col: str, vector_col: str, label_col: str, anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the rows of its label with the greatest products with it; the
    negatives of each are the rows of other labels with the greatest products from percent
    of the positive's to all of it.  Equal products go by smaller ids.  vector_col holds
    whole numbers.  percent is divisible by 20.

    Rows without id, label or vector, or with a null among its numbers take no part.  Rows
    are told apart by themselves, not by ids: a repeated row is another row, and a repeated
    anchor has results of its own.  Vectors of unequal lengths have no product, and those
    of no numbers 0.  Products must be of less than 62 bits, else ValueError.  Fewer rows than asked for are
    all returned; no rows give none.  Other columns are not looked at.
    """
    if percent % 20:
        raise ValueError("percent must be divisible by 20")
    spark = rows.sparkSession
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    whole = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    kinds = whole.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("longest")).collect()  # a row a length
    out, schema = new_path(spark, "negatives"), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for kind in kinds:
        if kind["longest"] >= LARGEST:
            raise ValueError("products of these vectors need more than 62 bits")
        index = Index(whole.where(F.size("vector") == kind["dim"]), kind["dim"], kind["n"], int(kind["longest"]), sample)
        for block in index.anchors(block_bytes):
            found = _mined(index, block, positives, negatives, percent)
            if found is not None:
                found.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _mined(index: Index, block: pa.Table, positives: int, negatives: int, percent: int) -> DataFrame | None:
    key, ids, label, vectors = block["row"].to_numpy(), block["id"].to_numpy(), block["label"].to_numpy(), _matrix(block["vector"], index.dim)
    # home cells first: what is found there bounds the search elsewhere
    home = sorted(set(block["cell"].to_pylist()))
    asked = Asked(key, key, label, vectors, np.full(len(key), NONE), np.full(len(key), ALL), True, positives)
    near = index.search(asked, home).toArrow()  # a block's, positives for each
    place = {k: n for n, k in enumerate(key.tolist())}
    for k, score, n in zip(near["key"].to_pylist(), near["score"].to_pylist(), near["place"].to_pylist()):
        if n == positives:
            asked.low[place[k]] = score
    if far := sorted(set(index.cells(asked)) - set(home)):
        more = index.search(asked, far).toArrow()
        near = pa.concat_tables([near, more])
    best = near.sort_by([("key", "ascending"), ("score", "descending"), ("id", "ascending")])
    keys = best["key"].to_numpy()
    first = np.arange(len(keys)) - np.searchsorted(keys, keys) < positives
    own = np.array([place[k] for k in keys[first].tolist()], np.int64)
    score, positive = best["score"].to_numpy()[first], best["id"].to_numpy()[first]
    low = -(-score * (percent // 20) // 5)
    able = low <= score  # never below 0
    own, score, positive, low = own[able], score[able], positive[able], low[able]
    if not len(own):
        return None
    window = Asked(np.arange(len(own)), key[own], label[own], vectors[own], low, score, False, negatives)
    cells = index.cells(window)
    if not cells:
        return None
    pairs = pa.table({"key": window.key, "anchor_id": ids[own], "positive_id": positive, "positive_score": score})
    spark = index.rows.sparkSession
    found = index.search(window, cells).join(F.broadcast(spark.createDataFrame(pairs)), "key")  # a block's positives
    return found.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector, for the registered query: labels of every seventh id moved on by one, components in 256ths, rounded down.

    Rows with a null or non-finite component take no part.
    """
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.where(v.isNotNull() & ~bad).select("vec_id", label.alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * 256)).alias("vector"))


def mined(embeddings: DataFrame) -> DataFrame:
    """mine() of prepared() rows, with every hundredth id an anchor."""
    return mine(prepared(embeddings), "vec_id", "vector", "label", F.col("vec_id") % 100 == 0)
