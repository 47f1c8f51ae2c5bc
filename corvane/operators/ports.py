"""Models and stores behind a call: rerankers, chat models, vector stores.

A call takes a request of several rows and gives answers that carry the index of what
they answer, in any order, as servers do.  Calls are made by Arrow batch within tasks,
again after a failure, and answers are put in their rows' order; a task that is run
again calls again, so stores must take an upsert twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol, TypeVar, runtime_checkable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.errors import DependencyError
from corvane.functions import text as tx
from corvane.operators import search
from corvane.operators.keyed import KeyedIndex

A = TypeVar("A")


@runtime_checkable
class Reranker(Protocol):
    """Scores of (query, text) pairs, each with the pair's index."""

    def score(self, pairs: Sequence[tuple[str, str]]) -> Iterable[tuple[int, float]]: ...


@runtime_checkable
class ChatModel(Protocol):
    """Replies to lists of messages (role, content), each with its list's index."""

    def generate(self, chats: Sequence[list[dict[str, str]]]) -> Iterable[tuple[int, str]]: ...


@runtime_checkable
class VectorStore(Protocol):
    """Rows by key outside of Spark.  query gives for each vector its index and the (key, score) of the best."""

    def upsert(self, rows: Sequence[dict[str, Any]]) -> None: ...

    def query(self, vectors: Sequence[list[float]], k: int) -> Iterable[tuple[int, list[tuple[str, float]]]]: ...

    def count(self) -> int: ...


@dataclass(frozen=True)
class Calls:
    """How calls are made: rows of a request, tries of each, and the seconds before the second, which double from then on."""

    size: int = 64
    tries: int = 3
    wait: float = 0.5

    def __post_init__(self):
        if self.size < 1 or self.tries < 1 or self.wait < 0:
            raise ValueError("size and tries must be positive, wait not negative")

    def tried(self, call: Callable[[], A]) -> A:
        """A timeout or a lost connection is tried again; what is still there after the last try is a DependencyError of that kind."""
        for n in range(self.tries):
            try:
                return call()
            except (TimeoutError, ConnectionError) as e:
                kind, last = "timeout" if isinstance(e, TimeoutError) else "unavailable", e
            if n + 1 < self.tries:
                time.sleep(self.wait * 2**n)
        raise DependencyError(f"after {self.tries} tries: {last}", kind) from last

    def answers(self, call: Callable[[Sequence], Iterable[tuple[int, A]]], rows: Sequence) -> list[A]:
        """The answers to all rows, in their order; DependencyError if one is missing, twice, or to nothing."""
        out: list[A] = []
        for first in range(0, len(rows), self.size):
            asked = rows[first : first + self.size]
            got = self.tried(lambda asked=asked: list(call(asked)))
            by_index = dict(got)
            if len(got) != len(asked) or by_index.keys() != set(range(len(asked))):
                raise DependencyError(f"{len(asked)} rows were asked for and {sorted(i for i, _ in got)[:20]} answered", "unavailable")
            out += [by_index[k] for k in range(len(asked))]
        return out


def reranked(candidates: DataFrame, model: Reranker, n: int = search.RERANKED, by: list[str] | None = None, query: str = "question", text: str = "text", calls: Calls = Calls()) -> DataFrame:
    """search.rerank() by a model's scores of (query, text)."""

    @F.pandas_udf("double")
    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(calls.answers(model.score, list(zip(queries.fillna(""), texts.fillna("")))), dtype=float)

    return search.rerank(candidates, score(query, text), n, by)


def generated(asked: DataFrame, model: ChatModel, messages: str = "messages", into: str = "answer", calls: Calls = Calls()) -> DataFrame:
    """asked with a model's reply to each row's messages (array<struct<role, content>>)."""

    @F.pandas_udf("string")
    def reply(chats: pd.Series) -> pd.Series:
        return pd.Series(calls.answers(model.generate, [[{"role": m["role"], "content": m["content"]} for m in (c if c is not None else [])] for c in chats]), dtype=object)

    # nothing may call twice for one row, as an expression that is looked at again would
    return asked.withColumn(into, reply.asNondeterministic()(messages))


def conversation(hits: DataFrame) -> DataFrame:
    """question_id, messages: what a chat model is sent for the passages of each question, by rank."""
    rows = hits.groupBy("question_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))  # few rows each
    return rows.select("question_id", tx.messages(F.col("question"), F.transform("x", lambda p: p["text"])).alias("messages"))


def sent(rows: DataFrame, store: VectorStore, calls: Calls = Calls()) -> int:
    """Upserts rows into a store outside of Spark, a request at a time; how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.to_pylist()
            for first in range(0, len(some), calls.size):
                calls.tried(lambda first=first: store.upsert(some[first : first + calls.size]))
            yield pa.RecordBatch.from_arrays([pa.array([len(some)], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def found(queries: DataFrame, store: VectorStore, k: int, query_key: str = "query_id", vector: str = "vector", calls: Calls = Calls()) -> DataFrame:
    """query_key, key, score, rank of the best in a store outside of Spark, in the order that it gives them."""
    schema = T.StructType([queries.schema[query_key], T.StructField("key", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = calls.answers(lambda vectors: store.query(vectors, k), batch.column(vector).to_pylist())
            at = [(q, key, score, rank) for q, own in enumerate(hits) for rank, (key, score) in enumerate(own[:k], 1)]
            asked, keys, scores, ranks = zip(*at) if at else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(query_key).take(pa.array(asked, pa.int64())), pa.array(keys, pa.string()), pa.array(scores, pa.float64()), pa.array(ranks, pa.int32())], schema.names)

    return queries.where(F.col(vector).isNotNull()).select(query_key, vector).mapInArrow(run, schema)


class SparkStore:
    """The same by Spark itself: a keyed index, searched by products; tables in and out instead of rows."""

    def __init__(self, index: KeyedIndex, vector: str = "embedding"):
        self.index, self.vector = index, vector

    def upsert(self, rows: DataFrame) -> int:
        return self.index.upsert(rows)

    def query(self, queries: DataFrame, k: int, query_key: str = "query_id", q_vector: str = "vector", digits: int | None = None) -> DataFrame:
        return search.product_topk(self.index.load(), queries, query_key, self.vector, q_vector, k, tie=[self.index.key], digits=digits)

    def count(self) -> int:
        return self.index.count()


def column(call: Callable[[Sequence], Iterable[tuple[int, Any]]], values: Column, kind: str, calls: Calls = Calls()) -> Column:
    """Any other call as a column: a request's values in, answers by index out."""

    @F.pandas_udf(kind)
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series(calls.answers(call, list(xs)), dtype=object)

    return run(values)
