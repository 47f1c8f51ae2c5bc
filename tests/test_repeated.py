"""Registered queries against their SQL on tables that repeat what the small test tables have once."""

import tracemalloc

import duckdb
import pytest
from oracle import comparable, sql_rows
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import embedders, keyed, reports
from corvane.plans import queries as engine


def agrees(spark, sf, name):
    df = engine.QUERIES[name](spark, str(sf))
    names, wanted = sql_rows(str(sf), engine.SQL[name])
    assert wanted and comparable(df.columns, [tuple(r) for r in df.collect()]) == comparable(names, wanted)


def copied(sf, to, name, replaced, times):
    duckdb.sql(f"COPY (SELECT t.* REPLACE ({replaced}) FROM '{sf}/{name}.parquet' t, range({times}) r(k)) TO '{to}/{name}.parquet' (FORMAT parquet)")


def test_pages_with_one_path_are_versions_each(spark, sf, tmp_path):
    copied(sf, tmp_path, "pages", "page_id + k * 1000000 AS page_id, html || k AS html", 3)
    agrees(spark, tmp_path, "document_versions")


@pytest.mark.parametrize("name", ["latency_sketches", "stream_sketches", "stream_latency"])
def test_latencies_of_more_values_than_a_sketch_are_exact(spark, sf, tmp_path, name):
    copied(sf, tmp_path, "events", "event_id + k * 1000000 AS event_id, CASE WHEN k % 2 = 0 THEN date_trunc('month', ts) ELSE ts END AS ts, CASE WHEN event_type = 'click' AND k % 9 = 1 THEN NULL ELSE value + k * 0.37 END AS value", 150)
    agrees(spark, tmp_path, name)


def test_exact_quantiles_whatever_the_sketches_say(spark):
    rows = [("a", float(k % 1000), 1 + k % 3) for k in range(3000)] + [(None, 7.0, 10**10), (None, 9.0, 1), ("b", None, 4)]
    counts = spark.createDataFrame(rows, "key string, value double, n long")
    spread = sorted(v for key, v, n in rows if key == "a" for _ in range(n))
    wanted = {("a", len(spread), *(spread[-(-len(spread) * q // 100) - 1] for q in (50, 95, 99))), (None, 10**10 + 1, 7.0, 7.0, 7.0), ("b", 4, None, None, None)}
    other = reports.sketched(spark.range(5).selectExpr("'a' AS key", "id * 1e9 AS value"), ["key"], "value")
    for sketches in (None, other):
        assert {tuple(r) for r in reports.exact_quantiles(counts, ["key"], sketches).collect()} == wanted


def test_passages_are_embedded_where_they_are(spark, sf):
    questions, passages = engine._asked(spark, sf)
    assert "Exchange" not in passages._jdf.queryExecution().executedPlan().toString()
    texts = [None, "", "?!", "One one two\n", "İstanbul K9 x", "word " * 5000, "a" * 70_000]
    rows = spark.createDataFrame([*enumerate(texts)], "id long, text string")
    other = dict(tx.bag_embeddings(rows, "id").collect())
    for r in rows.select("id", embedders.BagEmbedder(16).column(F.col("text").cast("binary")).alias("v")).collect():
        assert r["v"] == pytest.approx(other[r["id"]], abs=1e-9)


def test_a_batch_of_an_index_is_dealt_once(spark, tmp_path):
    store = keyed.KeyedIndex(spark, str(tmp_path / "index"), "id")
    rows = spark.range(100).selectExpr("id % 60 AS id", "repeat('x', 30) AS text")
    once = store._batch(rows, store.version(), None)  # is written as it lies
    assert "__bucket" in once.columns and once._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [store.upsert(rows) for _ in range(6)] == [100] * 6
    assert store.count() == 60 and "__bucket" not in store.load().columns


def test_embedding_holds_a_bounded_number_of_tokens(spark):
    kept = embedders._token_vector
    assert kept.cache_parameters()["maxsize"] <= 50_000
    values = [f"token{k} and{k}".encode() for k in range(60_000)]
    tracemalloc.start()
    try:
        found = embedders.BagEmbedder(16).embed(values)
        assert len(found) == len(values) and tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()


def test_images_made_from_a_small_file_are_spread(spark, sf):
    for name in ("frame_pages", "resized_pages", "image_pages"):
        assert engine.QUERIES[name](spark, sf).rdd.getNumPartitions() >= 4


def test_partial_counts_of_terms_travel_by_number(spark):
    divergence = pytest.importorskip("corvane.llm.divergence")
    texts = spark.createDataFrame([("en", "a", "tree and tree"), ("en", "b", "And rock"), ("fr", "a", "tree")], "lang string, source string, text string").repartition(3)
    found = divergence._recounted(texts, ["and", "tree"])
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert sorted(map(tuple, found.collect())) == [("en", "a", "and", 1), ("en", "a", "tree", 2), ("en", "b", "and", 1), ("fr", "a", "tree", 1)]
