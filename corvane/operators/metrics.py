"""Retrieval metrics over ranked lists: ranked(query, rank, item) and relevant(query, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(ranked: DataFrame, relevant: DataFrame, query: str = "query_id", item: str = "item") -> DataFrame:
    """ranked with hit, and running hits."""
    marks = relevant.select(query, item).dropDuplicates().withColumn("hit", F.lit(1))
    rows = ranked.join(marks, [query, item], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    up_to = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("hits", F.sum("hit").over(up_to))


def _gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1)


def ideal_dcg(n: Column, k: int) -> Column:
    """The best DCG that n relevant items can give."""
    steps = F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int"))
    return F.when(n > 0, F.aggregate(steps, F.lit(0.0), lambda a, i: a + _gain(i))).otherwise(0.0)


def per_query(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10, query: str = "query_id", item: str = "item") -> DataFrame:
    """per_judged() of ranked, judged by the pairs in relevant, which may repeat."""
    counts = relevant.select(query, item).dropDuplicates().groupBy(query).agg(F.count("*").alias("n"))
    return per_judged(judged(ranked, relevant, query, item), counts, queries, k, query)


def with_hits(ranked: DataFrame, hit: Column, query: str = "query_id") -> DataFrame:
    """ranked with hit, where a row says itself whether it is relevant, and running hits."""
    up_to = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("hit", F.coalesce(hit.cast("int"), F.lit(0))).withColumn("hits", F.sum("hit").over(up_to))


def per_judged(rows: DataFrame, counts: DataFrame, queries: DataFrame, k: int = 10, query: str = "query_id") -> DataFrame:
    """rows: ranked with hit and hits; counts: n, how many relevant items a query has.

    recall, precision, hit_rate, reciprocal_rank, average_precision, dcg and ndcg of each of queries, at k where it applies.

    A query without relevant items has 0 throughout, as has one without results.
    precision divides by k.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    near = F.col("rank") <= k
    hit = F.col("hit") == 1
    sums = rows.groupBy(query).agg(
        F.sum(F.when(near, F.col("hit")).otherwise(0)).alias("hits_at_k"),
        F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
        F.sum(F.when(hit, F.col("hits") / F.col("rank"))).alias("precisions"),
        F.sum(F.when(near & hit, _gain(F.col("rank")))).alias("gains"),
    )
    every = queries.select(query).dropDuplicates().join(counts, query, "left").join(sums, query, "left").fillna({"n": 0, "hits_at_k": 0, "precisions": 0.0, "gains": 0.0})
    some = F.col("n") > 0
    zero = lambda x: F.coalesce(F.when(some, x), F.lit(0.0))
    return every.select(
        query,
        zero(F.try_divide(F.col("hits_at_k"), F.col("n"))).alias("recall"),
        zero(F.col("hits_at_k") / k).alias("precision"),
        zero(F.when(F.col("hits_at_k") > 0, 1.0)).alias("hit_rate"),
        zero(1.0 / F.col("first_hit")).alias("reciprocal_rank"),
        zero(F.try_divide(F.col("precisions"), F.col("n"))).alias("average_precision"),
        zero(F.col("gains")).alias("dcg"),
        zero(F.try_divide(F.col("gains"), ideal_dcg(F.col("n"), k))).alias("ndcg"),
    )


def macro(metrics: DataFrame, query: str = "query_id") -> DataFrame:
    """One row of means over all queries; 0 without any."""
    names = [c for c in metrics.columns if c != query]
    return metrics.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names), F.count("*").alias("queries")).withColumnsRenamed({"reciprocal_rank": "mrr", "average_precision": "map"})


def from_gold(gold: DataFrame, ranked: str = "ranked", relevant: str = "relevant", query: str = "query_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked, relevant, queries) from rows with arrays."""
    lists = gold.select(query, F.posexplode(ranked).alias("place", "item")).select(query, (F.col("place") + 1).alias("rank"), "item")
    return lists, gold.select(query, F.explode(relevant).alias("item")), gold.select(query)
