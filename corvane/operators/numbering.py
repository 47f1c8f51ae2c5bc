"""Places of rows within groups, of which one may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Into how many parts by order a group is cut at most, and how many sampled keys there are for each.
PARTS, SAMPLED = 64, 32


def sampled_keys(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Up to n distinct keys, evenly from all distinct ones: of each of n classes by hash the one of the least hash.  Tasks hand on n keys each at most."""
    h = F.xxhash64(*order)
    return df.groupBy(F.pmod(h, F.lit(n)).alias("__class")).agg(F.min_by(F.struct(*order), h).alias("__key")).select("__key.*")


def _part(df: DataFrame, order: str) -> Column:
    """Which range of order a row is in; the edges are of PARTS * SAMPLED keys at most."""
    some = sampled_keys(df.select(order).where(F.col(order).isNotNull()), [order], PARTS * SAMPLED).collect()
    edges = sorted(r[order] for r in some)[SAMPLED::SAMPLED]
    if not edges:
        return F.lit(0)
    kind = df.schema[order].dataType
    upto = F.filter(F.array(*(F.lit(e).cast(kind) for e in edges)), lambda e: e <= F.col(order))
    return F.when(F.col(order).isNull(), 0).otherwise(F.size(upto))


def numbered(df: DataFrame, by: str, order: str, into: str) -> DataFrame:
    """df with into: a row's place within by from 1, by order, nulls first; ties are in any order.  Rows with a null in by are one group.

    Rows are numbered within ranges of order, each in a task of its own, and the
    sizes of a group's lower ranges are added, so no task sorts a whole large group.
    """
    marked = df.withColumn("__part", _part(df, order))
    sizes = marked.groupBy(F.col(by).alias("__by"), F.col("__part").alias("__at")).agg(F.count("*").alias("__n"))
    lower = Window.partitionBy("__by").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__by", "__at", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__before"))  # up to PARTS rows a group
    local = marked.withColumn("__place", F.row_number().over(Window.partitionBy(by, "__part").orderBy(order)))
    both = local.join(before, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__at")))
    return both.select(*df.columns, (F.col("__before") + F.col("__place")).alias(into))
