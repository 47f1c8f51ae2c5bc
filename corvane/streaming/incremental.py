"""Indexes that grow from a stream of files; an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators import index, reports
from corvane.operators.keyed import KeyedIndex


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def once_by(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """The stream with each key once within the time that late rows are waited for."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def append_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Appends what is there to the index at target and stops; what was read once is not read again."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").outputMode("append").start(target).awaitTermination()


def upsert_available(stream: DataFrame, target: str, checkpoint: str, key: str, seq: str, buckets: int = 64) -> DataFrame | None:
    """Upserts what is there into the index at target, batch by batch, and stops; the index then, or None if no batch ever came.

    A batch adds a part to the buckets of its keys and leaves the others as they are; one
    that is run again after a failure is known by its number and written once.  Its ordinal
    is the least seq of its key; the values are those of the greatest.  Of older versions
    the last stays.
    """
    store = KeyedIndex(stream.sparkSession, target, key, buckets)

    def write(rows: DataFrame, n: int) -> None:
        store.upsert(rows, seq, n)
        store.vacuum()

    run = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return store.load() if store.exists() else None


def windowed_latency(stream: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window, by, requests and approximate p50, p95, p99."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width), by).agg(F.count("*").alias("requests"), F.percentile_approx(value, [0.5, 0.95, 0.99]).alias("p"))


def windowed_sketches(stream: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window, by, requests and sketch, which reports.merged() puts together over longer windows."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return reports.sketched(rows.withColumn("window", F.window(ts, width)), ["window", by], value)


def counted_available(stream: DataFrame, target: str, checkpoint: str, ts: str, by: str, value: str, width: str = "1 hour") -> DataFrame:
    """Counts what is there, batch by batch, and stops: window, by, value, n of all batches so far, for reports.exact_quantiles().

    A batch adds a part of counts of its own, and one that is run again after a failure
    replaces it.  No state is held between batches, and no row is too late.
    """
    spark, keys = stream.sparkSession, ["window", by]
    marked = stream.select(F.window(F.col(ts).cast("timestamp"), width).alias("window"), by, value)

    def write(rows: DataFrame, n: int) -> None:
        reports.counted(rows, keys, value).write.mode("overwrite").parquet(f"{target}/batch={n}")

    marked.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    schema = T.StructType([*marked.select(*keys).schema, T.StructField("value", T.DoubleType()), T.StructField("n", T.LongType())])
    return spark.read.schema(schema).parquet(target) if index.IndexStore(spark, target).exists() else spark.createDataFrame([], schema)


def whole_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Writes an aggregated stream's result over all that is there to target and stops."""
    store = index.IndexStore(stream.sparkSession, target)
    run = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("complete").foreachBatch(lambda rows, n: store.save(rows)).start()
    run.awaitTermination()
