"""Exact search over an index table.

Without normalised scores the filter comes first and reaches the scan.  With
them the least and the greatest score are taken over all rows by an aggregate
of one row, and the filter follows, as it must not move them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.errors import EmptyIndexError
from corvane.functions import vectors as vx
from corvane.operators import filters
from corvane.operators.numbering import sampled_keys

#: Ranges below count as none.
EPS = 1e-9
#: Candidates from retrieval, and what reranking keeps of them.
RETRIEVED, RERANKED = 20, 5


def finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (score > float("-inf"))


def minmax_column(score: Column, low: Column, high: Column, eps: float = EPS) -> Column:
    """score between 0 and 1; 0 if the range is below eps, or, with eps 0, if there is none."""
    flat = (high - low) < eps if eps else high == low
    return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(score - low, high - low))


def minmax(df: DataFrame, score: str = "score", into: str = "normalized_score", by: list[str] | None = None, eps: float = EPS) -> DataFrame:
    """df with scores normalised over all rows, or over those that share by; no rows give no rows."""
    ends = df.groupBy(*(by or [])).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    both = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))  # one row
    return both.withColumn(into, minmax_column(F.col(score), F.col("__low"), F.col("__high"), eps)).drop("__low", "__high")


def top_k(df: DataFrame, k: int, score: str = "score", tie: list[str] | None = None) -> DataFrame:
    """The k best rows with rank from 1; equal scores are ordered by tie."""
    if k < 0:
        raise ValueError("k must not be negative")
    order = [F.desc(score), *(F.asc(t) for t in tie or [])]
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def top_k_by(df: DataFrame, by: list[str], k: int, score: str = "score", tie: list[str] | None = None) -> DataFrame:
    """The k best rows of each group, with rank."""
    if k < 0:
        raise ValueError("k must not be negative")
    order = Window.partitionBy(*by).orderBy(F.desc(score), *(F.asc(t) for t in tie or []))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, scored: Column, k: int = 10, spec: Any = None, normalized: bool = False, tie: list[str] | None = None, check_empty: bool = False) -> DataFrame:
    """The k best rows of index under spec, by the expression scored, with score and rank.

    Scores that are null, NaN or minus infinity are left out before all else.
    """
    if check_empty and index.isEmpty():
        raise EmptyIndexError("the index is empty")
    if not normalized:
        index = filters.apply(index, spec)
    rows = index.withColumn("score", scored).where(finite(F.col("score")))
    if normalized:
        rows = filters.apply(minmax(rows), spec)
    return top_k(rows, k, tie=tie)


def search_batch(index: DataFrame, queries: DataFrame, scored: Column, query_key: str, k: int = 10, spec: Any = None, tie: list[str] | None = None) -> DataFrame:
    """search() for a stated set of queries, whose columns must not clash with the index's.

    The queries are counted.  Up to QUERIES are sent to every task; more are dealt to
    blocks of about as many, each against the whole index.
    """
    rows, blocks = filters.apply(index, spec), max(1, -(-queries.count() // QUERIES))
    parts = [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b) for b in range(blocks)]
    pairs = (rows.crossJoin(F.broadcast(q)).withColumn("score", scored).where(finite(F.col("score"))) for q in parts)
    return reduce(DataFrame.unionByName, (top_k_by(p, [query_key], k, tie=tie) for p in pairs))


#: Up to how many queries, their rows are sent to every task; more go in blocks of as many.
QUERIES = 10_000


#: Up to how many bytes of query vectors are sent to every task, how many queries are multiplied at once, and how many products are held at once.
QUERY_BYTES, AT_ONCE, PRODUCTS = 1 << 26, 256, 1 << 22


def product_topk(index: DataFrame, queries: DataFrame, query_key: str, vector: str, q_vector: str, k: int = 10, spec: Any = None, tie: list[str] | None = None, cosine: bool = False, digits: int | None = None, normalized: bool = False) -> DataFrame:
    """search_batch() by products (or cosines) of vectors: query_key, the index's columns but vector, score and rank.

    queries: query_key and q_vector, a stated set.  Its vectors, in blocks of up to
    QUERY_BYTES, go to every task, which multiplies them with an Arrow batch of the index
    at once and hands on the batch's k best for each query only, so no pair beyond these
    leaves the task.  Scores are rounded to digits, halves away from zero, before they are
    compared.  Vectors of unequal lengths, null ones and those with nulls have no score.

    normalized: normalized_score as well, over all rows of the index whatever spec says;
    the same pass takes each query's least and greatest score, a row a task.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    asked = queries.where(F.col(q_vector).isNotNull()).select(query_key, F.col(q_vector).cast("array<double>").alias(q_vector), F.size(q_vector).alias("__dim"))
    dims = asked.groupBy("__dim").agg(F.count("*").alias("n")).collect()  # a row for each length of vectors
    rows, schema = _marked(index, vector, spec, normalized, queries.schema[query_key])
    parts = []
    for dim, n in sorted((r["__dim"], r["n"]) for r in dims):
        fit = rows.where(F.size(vector) == dim).withColumn(vector, F.col(vector).cast("array<double>"))
        for block in _blocks(asked.where(F.col("__dim") == dim).select(query_key, q_vector), query_key, n * 8 * max(dim, 1)):
            parts.append(fit.mapInArrow(_best_of_batches(block, query_key, _products(block, q_vector, vector, dim, cosine), vector, k, tie or [], digits, normalized), schema))
    return _of_all(parts, index, schema, query_key, k, tie, normalized)


def maxsim_topk(index: DataFrame, queries: DataFrame, query_key: str, vector: str, q_vector: str, k: int = 10, spec: Any = None, tie: list[str] | None = None, digits: int | None = None, normalized: bool = False) -> DataFrame:
    """product_topk() by MaxSim of multi-vectors, arrays of arrays.

    A task multiplies the vectors of a block of queries with those of a slice of pages,
    takes for each query vector the greatest product of each page, and sums up over a
    query's vectors; PRODUCTS bounds what it holds, and a page with more vectors is a slice
    of its own.  A page scores only if each of the query's vectors has one of its length
    there; null vectors and those with nulls are passed over, in a query they leave it without a score.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    kind = "array<array<double>>"
    asked = queries.where(F.col(q_vector).isNotNull()).select(query_key, F.col(q_vector).cast(kind).alias(q_vector))
    size = asked.agg(F.sum(F.aggregate(q_vector, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.size(x), F.lit(0)))).alias("n")).first()["n"]
    rows, schema = _marked(index, vector, spec, normalized, queries.schema[query_key])
    fit = rows.withColumn(vector, F.col(vector).cast(kind))
    parts = []
    if size is not None:
        for block in _blocks(asked, query_key, 8 * size):
            parts.append(fit.mapInArrow(_best_of_batches(block, query_key, _maxsims(block[q_vector].combine_chunks(), vector), vector, k, tie or [], digits, normalized), schema))
    return _of_all(parts, index, schema, query_key, k, tie, normalized)


def _marked(index: DataFrame, vector: str, spec: Any, normalized: bool, key: T.StructField) -> tuple[DataFrame, T.StructType]:
    """The rows to look at, and what tasks hand on; if scores are normalised, __fits says which rows spec lets through."""
    rows = index.withColumn("__fits", F.coalesce(filters.compiled(spec, index.schema), F.lit(False))) if normalized else filters.apply(index, spec)
    kept = [f for f in index.schema if f.name != vector]
    ends = [T.StructField("__low", T.DoubleType()), T.StructField("__high", T.DoubleType())] if normalized else []
    free = [T.StructField(f.name, f.dataType, True) for f in kept]
    return rows.select(*(f.name for f in kept), *(["__fits"] if normalized else []), vector), T.StructType([key, *free, T.StructField("score", T.DoubleType()), *ends])


def _blocks(asked: DataFrame, query_key: str, size: int) -> Iterator[pa.Table]:
    """The queries in blocks of about QUERY_BYTES."""
    blocks = max(1, -(-size // QUERY_BYTES))
    for b in range(blocks):
        yield (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b)).toArrow()


def _of_all(parts: list[DataFrame], index: DataFrame, schema: T.StructType, query_key: str, k: int, tie: list[str] | None, normalized: bool) -> DataFrame:
    """The k best of what all tasks handed on."""
    found = reduce(DataFrame.unionByName, parts) if parts else index.sparkSession.createDataFrame([], schema)
    if not normalized:
        return top_k_by(found, [query_key], k, tie=tie)
    every = Window.partitionBy(query_key)
    ends = found.withColumns({"__low": F.min("__low").over(every), "__high": F.max("__high").over(every)}).where(F.col("score").isNotNull())
    return top_k_by(ends.withColumn("normalized_score", minmax_column(F.col("score"), F.col("__low"), F.col("__high"))).drop("__low", "__high"), [query_key], k, tie=tie)


def _products(block: pa.Table, q_vector: str, vector: str, dim: int, cosine: bool):
    """Scores of queries a:b with the rows of a batch, NaN for those that don't count."""
    asked = _matrix(block[q_vector].combine_chunks(), dim)
    asked_norms = np.sqrt((asked * asked).sum(1))

    def scores(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        own = _matrix(batch.column(vector), dim)
        for a in range(0, len(asked), AT_ONCE):
            with np.errstate(all="ignore"):
                out = asked[a : a + AT_ONCE] @ own.T
                if cosine:
                    out /= asked_norms[a : a + AT_ONCE, None] * np.sqrt((own * own).sum(1)) + EPS
            yield a, out

    return scores


def _maxsims(asked: pa.Array, vector: str):
    """Scores as _products() has them, by MaxSim of multi-vectors."""
    n, vectors = len(asked), _by_length(asked)
    whole = np.ones(n, bool)  # queries none of whose vectors is null or has a null
    seen = np.zeros(n, np.int64)
    for _, owner in vectors.values():
        seen += np.bincount(owner, minlength=n)
    whole &= seen == pc.fill_null(pc.list_value_length(asked), 0).to_numpy(zero_copy_only=False)

    def scores(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        pages = _by_length(batch.column(vector))
        for a in range(0, n, AT_ONCE):
            b = min(n, a + AT_ONCE)
            out = np.zeros((b - a, len(batch)))
            out[~whole[a:b]] = np.nan
            with np.errstate(all="ignore"):
                for dim, (queries, owner) in vectors.items():
                    mine = slice(*np.searchsorted(owner, [a, b]))
                    _add_best(out, queries[mine], owner[mine] - a, *pages.get(dim, (np.zeros((0, dim)), np.zeros(0, np.int64))))
            yield a, out

    return scores


def _add_best(out: np.ndarray, queries: np.ndarray, asker: np.ndarray, own: np.ndarray, page: np.ndarray) -> None:
    """Adds to out[asker, page] each query vector's greatest product with a page's vectors; where a page has none, NaN."""
    have, starts = np.unique(page, return_index=True)
    lacking = np.setdiff1d(np.arange(out.shape[1]), have)
    if len(lacking):
        out[np.ix_(np.unique(asker), lacking)] = np.nan
    ends = np.append(starts[1:], len(page))
    first = 0
    while first < len(have):  # slices of whole pages
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PRODUCTS // AT_ONCE, side="right")))
        some = own[starts[first] : ends[last - 1]]
        step = max(1, PRODUCTS // len(some))
        for k in range(0, len(queries), step):
            best = np.maximum.reduceat(queries[k : k + step] @ some.T, starts[first:last] - starts[first], axis=1)
            askers, begins = np.unique(asker[k : k + step], return_index=True)
            out[np.ix_(askers, have[first:last])] += np.add.reduceat(best, begins, axis=0)
        first = last


def _by_length(multi: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of multi-vectors: for each length of vectors these, one a row, and which multi-vector has each; those that are null or have a null are left out."""
    owner = pc.list_parent_indices(multi).to_numpy(zero_copy_only=False)
    each = multi.flatten()
    lengths = pc.fill_null(pc.list_value_length(each), -1).to_numpy(zero_copy_only=False)
    numbers = each.flatten()
    if numbers.null_count:
        holed = np.unique(pc.list_parent_indices(each).to_numpy(zero_copy_only=False)[pc.is_null(numbers).to_numpy(zero_copy_only=False)])
        lengths = lengths.copy()
        lengths[holed] = -1
    return {int(dim): (_matrix(each.take(pa.array(at)), int(dim)), owner[at]) for dim in np.unique(lengths[lengths >= 0]) for at in [np.flatnonzero(lengths == dim)]}


def _best_of_batches(block: pa.Table, query_key: str, scores, vector: str, k: int, tie: list[str], digits: int | None, normalized: bool):
    """For each Arrow batch the k best rows of each query, best by score, then tie; if normalised, at the end each query's least and greatest score."""
    keys = block[query_key].combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, rest = np.full(len(keys), np.inf), np.full(len(keys), -np.inf), None
        for batch in batches:
            if not len(batch) or not (k or normalized):
                continue
            if tie:  # so that of equal scores the first are taken
                batch = batch.take(pc.sort_indices(batch.select(tie), [(t, "ascending") for t in tie], null_placement="at_start"))
            rest = batch.drop_columns([vector, "__fits"] if normalized else [vector])
            for a, found in scores(batch):
                if digits is not None:
                    found = np.copysign(np.floor(np.abs(found) * 10.0**digits + 0.5) / 10.0**digits, found) + 0.0
                found = np.where(np.isnan(found), -np.inf, found)
                if normalized:
                    b = a + len(found)
                    low[a:b] = np.minimum(low[a:b], np.where(found > -np.inf, found, np.inf).min(1))
                    high[a:b] = np.maximum(high[a:b], found.max(1))
                    found = np.where(batch.column("__fits").to_numpy(zero_copy_only=False), found, -np.inf)
                query, row = _first(found, k)
                ends = [pa.nulls(len(row), pa.float64())] * 2 if normalized else []
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(query + a)), *rest.take(pa.array(row)).columns, pa.array(found[query, row]), *ends], [query_key, *rest.schema.names, "score", *(["__low", "__high"] if normalized else [])])
        some = np.flatnonzero(high > -np.inf)
        if normalized and len(some):
            nothing = [pa.nulls(len(some), f.type) for f in rest.schema]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)), *nothing, pa.nulls(len(some), pa.float64()), pa.array(low[some]), pa.array(high[some])], [query_key, *rest.schema.names, "score", "__low", "__high"])

    return run


def _first(found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and rows of the k best of each query, the first of equal ones; minus infinity doesn't count."""
    if not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = found.shape[1]
    least = np.partition(found, n - k, axis=1)[:, n - k, None] if n > k else -np.inf
    query, row = np.nonzero((found >= least) & (found > -np.inf))
    order = np.lexsort((row, -found[query, row], query))
    query, row = query[order], row[order]
    near = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[near], row[near]


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of dim numbers, one a row; nulls are NaN."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)


def token_topk(asked: DataFrame, docs: DataFrame, k: int, query: str, key: str, digits: int = 9) -> DataFrame:
    """query, key, score, rank: for each of a stated set of queries the k documents with the greatest Jaccard similarity of tokens, ties by key.

    asked: query, tokens; docs: key, tokens, each without repeats.  Shared tokens are
    counted by an equi-join; the union follows from sizes.  Documents that share nothing
    count only where fewer than k share something: then those with the least keys.
    """
    # outer, as explode() has a filter on its array inferred, which moves below and makes every array again; null joins nothing
    ours = asked.select(query, F.size("tokens").alias("__a"), F.explode_outer("tokens").alias("__token"))
    theirs = docs.select(key, F.size("tokens").alias("__b"), F.explode_outer("tokens").alias("__token"))
    both = theirs.join(ours, "__token").groupBy(query, key, "__a", "__b").agg(F.count("*").alias("__n"))
    score = F.round(F.col("__n") / (F.col("__a") + F.col("__b") - F.col("__n")), digits)
    found = top_k_by(both.select(query, key, score.alias("score")), [query], k, tie=[key]).select(query, key, "score")
    fewer = asked.select(query).join(found.groupBy(query).agg(F.count("*").alias("__n")), query, "left").where(F.coalesce("__n", F.lit(0)) < k).select(query)
    least = docs.select(key).orderBy(key).limit(2 * k)  # of 2 k least keys, fewer than k are found already
    rest = fewer.crossJoin(F.broadcast(least)).join(found, [query, key], "left_anti").withColumn("score", F.lit(0.0))
    return top_k_by(found.unionByName(rest), [query], k, tie=[key])


def maxsim_by(rows: DataFrame, by: list[str], query: list[list[float]], vector: str = "embedding") -> DataFrame:
    """by and score: MaxSim of a query's vectors with pages whose vectors are rows that share by.

    Each query vector's best product is one partial aggregate, so no page is held as a
    whole.  A page none of whose vectors fits scores null; a query without vectors is an error.
    """
    if not query:
        raise ValueError("the query has no vectors")
    best = [F.max(vx.dot(F.col(vector), vx.vector(q))).alias(f"__{k}") for k, q in enumerate(query)]
    found = rows.groupBy(*by).agg(*best)
    return found.select(*by, reduce(add, (F.col(f"__{k}") for k in range(len(query)))).alias("score"))


def rerank(candidates: DataFrame, scored: Column, n: int = RERANKED, by: list[str] | None = None, tie: str = "rank") -> DataFrame:
    """The n best by another score, kept as rerank_score; equal ones stay in their order."""
    rows = candidates.withColumn("rerank_score", scored).withColumnRenamed("rank", "retrieval_rank")
    tie = "retrieval_rank" if tie == "rank" else tie
    return top_k_by(rows, by, n, "rerank_score", [tie]) if by else top_k(rows, n, "rerank_score", [tie])


def not_reranked(candidates: DataFrame, n: int = RERANKED) -> DataFrame:
    """The first n as they are, without a rerank_score."""
    return candidates.where(F.col("rank") <= n).withColumn("rerank_score", F.lit(None).cast("double"))


def from_arrays(df: DataFrame, key: str, pages: str, raw: str) -> DataFrame:
    """key, rank, page, score, normalized_score from parallel arrays: best first, ties as given; a row's equal scores normalise to 0."""
    each = df.select(key, F.posexplode(F.arrays_zip(F.col(pages).alias("page"), F.col(raw).alias("score"))).alias("place", "x"), F.array_min(raw).alias("low"), F.array_max(raw).alias("high"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "place")
    rows = each.select(key, "place", F.col("x.page").alias("page"), F.col("x.score").alias("score"), "low", "high")
    return rows.select(key, F.row_number().over(order).alias("rank"), "page", "score", minmax_column(F.col("score"), F.col("low"), F.col("high"), 0).alias("normalized_score"))


#: Up to which offset and limit together a page is taken from a sort of the first rows; ranges that a deeper one is looked for in, and sampled keys for each.
SHALLOW, RANGES, SAMPLED = 100_000, 64, 32


def page_of(df: DataFrame, order: list[str], offset: int = 0, limit: int = 10, shallow: int = SHALLOW) -> DataFrame:
    """Rows offset to offset + limit in that order, nulls first.

    The first offset + limit rows are sorted by one task if these are shallow at most.
    Deeper pages are looked for range by range: the rows in RANGES of the order are counted,
    and only the ranges that hold the page are looked at again, until shallow rows are
    before it.  Rows that are equal in order are told apart by a hash of all columns.
    """
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative, limit must be positive")
    if offset + limit <= shallow:
        return df.orderBy(*order).offset(offset).limit(limit)
    rows, order = df.withColumn("__tie", F.xxhash64(*df.columns)), [*order, "__tie"]
    key = F.struct(*order)
    while offset + limit > shallow:
        edges = _edges(rows, order)
        at = [F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, e))) for e in edges]
        part = F.size(F.filter(F.array(*at), lambda e: e <= key)) if at else F.lit(0)
        counts = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # RANGES at most
        before, held = 0, []
        for k in range(len(edges) + 1):
            if before + counts.get(k, 0) > offset and before < offset + limit:
                held.append((k, before))
            before += counts.get(k, 0)
        if not held or len(held) > len(edges):
            break  # no rows there, or no range is narrower: all rows are alike, or the page has them all
        low, high = held[0][0], held[-1][0]
        rows = rows.where(_from(order, edges[low - 1], at[low - 1], key) if low else F.lit(True)).where(key < at[high] if high < len(at) else F.lit(True))
        offset -= held[0][1]
    return rows.orderBy(*order).offset(offset).limit(limit).drop("__tie")


def _edges(rows: DataFrame, order: list[str]) -> list[tuple]:
    """Keys that part the rows into RANGES or a few more, evenly from the distinct ones."""
    keys = [tuple(r) for r in sampled_keys(rows, order, RANGES * SAMPLED).orderBy(*order).collect()]
    step = max(1, len(keys) // RANGES)
    return keys[step::step]


def _from(order: list[str], edge: tuple, at: Column, key: Column) -> Column:
    """Keys from an edge on; the first column alone, which a scan can use, says nearly as much."""
    first = F.col(order[0]) >= F.lit(edge[0]) if edge[0] is not None and edge[0] == edge[0] else F.lit(True)
    return first & (key >= at)


def page_info(df: DataFrame, offset: int = 0, limit: int = 10) -> DataFrame:
    """One row: total, page_number, num_pages, has_next, has_previous."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative, limit must be positive")
    total = F.col("total")
    return df.agg(F.count("*").alias("total")).select("total", F.lit(offset // limit + 1).alias("page_number"), F.ceil(total / limit).cast("long").alias("num_pages"), (F.lit(offset + limit) < total).alias("has_next"), F.lit(offset > 0).alias("has_previous"))


def fuse(rankings: list[DataFrame], key: list[str], k: int = 60, top: int | None = None) -> DataFrame:
    """key, score, rank: reciprocal rank fusion of lists with a rank; a key that is twice in one list counts twice.

    Equal scores are ordered by first appearance.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = None
    for n, ranking in enumerate(rankings):
        one = ranking.select(*key, F.col("rank").cast("long").alias("rank"), F.lit(n).alias("list"))
        rows = one if rows is None else rows.unionByName(one)
    fused = rows.groupBy(*key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = [F.desc("score"), "first"]
    if top is not None:
        fused = fused.orderBy(*order).limit(top)
        return fused.select(*key, "score", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    return fused.select(*key, "score")
