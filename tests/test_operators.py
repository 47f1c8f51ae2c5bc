import json
import pathlib
import re
import struct

import pytest
from pyspark.sql import functions as F

from corvane.errors import BackendUnavailableError, CorpusError, EmptyIndexError, IndexStoreError, UnsupportedFormatError
from corvane.functions import files as fx
from corvane.functions import geometry as gx
from corvane.functions import vectors as vx
from corvane.operators import chunking, embedders, filters, index, metrics, rag, reports, search
from corvane.session import Settings
from corvane.sources import files as sources
from corvane.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_maxsim_and_cosine(spark):
    q, d = vx.multi_vector([[1, 0], [0, 1], [1, 1]]), vx.multi_vector([[1, 0], [0, 2], [0.5, 0.5], [3, 0]])
    assert one(spark, vx.maxsim(q, d)) == 8
    assert one(spark, vx.cosine(vx.vector([0.6, 0.8]), vx.vector([0.6, 0.8]))) == pytest.approx(1)
    assert one(spark, vx.cosine(vx.vector([0, 0]), vx.vector([1, 0]))) == 0
    assert one(spark, vx.dot(vx.vector([1]), vx.vector([1, 2]))) is None


PAGES = [("invoice.png", "png", 1, 2021, "en"), ("report.png", "png", 1, 2024, "en"), ("memo.jpg", "jpg", 1, 2024, "fr"), ("none.jpg", "jpg", 1, None, None)]


@pytest.mark.parametrize(
    "spec, files",
    [
        ({"year": {"$gte": 2024}}, {"report.png", "memo.jpg"}),
        ({"lang": ["fr"]}, {"memo.jpg"}),
        ({"year": {"ne": 2024}}, {"invoice.png", "none.jpg"}),
        ({"lang": {"nin": ["en"]}}, {"memo.jpg", "none.jpg"}),
        ({"lang": {"in": ["fr", None]}}, {"memo.jpg", "none.jpg"}),
        ({"year": {"eq": "2024"}}, set()),
        ({"year": {"ne": "2024"}}, {p[0] for p in PAGES}),
        ({"year": {"lt": None}}, set()),
        ({"file": {"regex": "^(?P<a>m|r)e"}}, {"report.png", "memo.jpg"}),
        ({"year": {"contains": "x"}}, set()),
        ({"absent": {"exists": False}}, {p[0] for p in PAGES}),
        ({"absent": {"ne": 1}, "year": None}, {p[0] for p in PAGES}),
        ({"year": {"GTE": 2021, "lt": 2024}}, {"invoice.png"}),
    ],
)
def test_filters(spark, spec, files):
    pages = spark.createDataFrame(PAGES, "file string, format string, page int, year int, lang string")
    assert {r["file"] for r in filters.apply(pages, spec).collect()} == files


def test_filters_on_lists_and_maps(spark):
    df = spark.sql("select 1 as k, array('a', null) as l, map('x', 1) as m union all select 2, null, null")
    got = lambda s: [r["k"] for r in filters.apply(df, s).orderBy("k").collect()]
    assert got({"l": {"contains": "a"}}) == [1] and got({"l": {"contains": "b"}}) == [] and got({"m": {"contains": "x"}}) == [1]


def test_filter_errors():
    for bad in (lambda: filters.FieldFilter("a", "like", 1), lambda: filters.FieldFilter(" ", "eq", 1), lambda: filters.FieldFilter("a", "in", "abc"), lambda: filters.Query("  ")):
        with pytest.raises(ValueError):
            bad()
    assert filters.Query("x", {"a": 1}).with_filter("b", "gt", 2).filters.fields() == {"a", "b"}


def test_metrics_by_hand(spark):
    gold = spark.createDataFrame([(1, [1, 2, 3, 4], [2, 4]), (2, [1, 2], [])], "query_id int, ranked array<int>, relevant array<int>")
    ranked, relevant, queries = metrics.from_gold(gold)
    a, b = metrics.per_query(ranked, relevant, queries, 4).orderBy("query_id").collect()
    assert (a["recall"], a["precision"], a["hit_rate"], a["reciprocal_rank"], a["average_precision"]) == (1, 0.5, 1, 0.5, 0.5)
    assert a["dcg"] == pytest.approx(1.0616, abs=1e-4) and a["ndcg"] == pytest.approx(0.6509, abs=1e-4)
    assert all(b[c] == 0 for c in ("recall", "precision", "ndcg", "average_precision"))
    assert metrics.macro(metrics.per_query(ranked, relevant, queries.limit(0), 4)).first()["mrr"] == 0


def test_search_rules(spark):
    rows = spark.createDataFrame([(1, 1.0, "a"), (2, 5.0, "b"), (3, 5.0, "b"), (4, float("nan"), "b")], "id int, s double, g string")
    got = search.search(rows, F.col("s"), 2, {"g": "b"}, normalized=True, tie=["id"]).orderBy("rank").collect()
    assert [(r["id"], r["normalized_score"]) for r in got] == [(2, 1.0), (3, 1.0)]
    assert "TakeOrderedAndProject" in search.top_k(rows, 2, "s", ["id"])._jdf.queryExecution().toString()
    with pytest.raises(EmptyIndexError):
        search.search(rows.limit(0), F.col("s"), check_empty=True)
    with pytest.raises(ValueError):
        search.top_k(rows, -1, "s")
    lists = [spark.createDataFrame([(k, n + 1) for n, k in enumerate(x)], "key string, rank int") for x in ("xyz", "yxw")]
    assert {r["key"] for r in search.fuse(lists, ["key"], top=2).collect()} == {"x", "y"}


def test_boxes(spark):
    b = lambda *x: gx.box(*(F.lit(float(v)) for v in x))
    assert tuple(one(spark, gx.intersection(b(0, 0, 2, 2), b(1, 1, 3, 3)))) == (1, 1, 2, 2)
    assert one(spark, gx.iou(b(0, 0, 2, 2), b(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, gx.intersection(b(0, 0, 1, 1), b(1, 0, 2, 1))) is None and one(spark, gx.iou(b(0, 0, 1, 1), b(5, 5, 6, 6))) == 0
    assert tuple(one(spark, gx.scaled(b(10, 20, 50, 80), F.lit(100), F.lit(200)))) == (0.1, 0.1, 0.5, 0.4)


def test_sizes_and_paths(spark):
    said = {0: "0 B", 512: "512 B", 1024: "1.0 KB", 1536: "1.5 KB", 1048576: "1.0 MB", 5242880: "5.0 MB", -1536: "-1.5 KB"}
    assert {k: one(spark, fx.human_size(F.lit(k))) for k in said} == said
    assert one(spark, fx.format_of(F.lit("/a.b/c.TIF"))) == "tiff" and one(spark, fx.format_of(F.lit("/a.b/c"))) is None
    assert one(spark, fx.stem(F.lit("/x/a.tar.gz"))) == "a.tar"


def test_chunks(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(250)))), (2, "  "), (3, None)], "doc_id int, text string")
    got = chunking.chunk(docs, 100, 20).orderBy("chunk").collect()
    assert [r["n_words"] for r in got] == [100, 100, 90] and [r["passage_id"] for r in got] == ["1:0", "1:1", "1:2"]
    for overlap in (10, 15, -1):
        with pytest.raises(ValueError):
            chunking.chunk(docs, 10, overlap)


def test_files_and_corpora(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "b.txt", "c.md", "ignore.bin", "no_extension", "sub/d.txt"):
        (tmp_path / name).write_text("x")
    found = sources.discover(spark, str(tmp_path), with_checksum=True)
    assert {r["format"]: r["files"] for r in sources.count_by_format(found).collect()} == {"pdf": 1, "txt": 2, "md": 1}
    assert sources.discover(spark, str(tmp_path), [".PDF", "MD"]).count() == 2
    assert sources.iter_files(spark, str(tmp_path / "missing")).count() == 0
    with pytest.raises(UnsupportedFormatError):
        sources.renderers(found, {"pdf": "x"})
    lines = tmp_path / "c.jsonl"
    lines.write_text('{"id": "1", "title": "t", "text": "x"}\n\n{"id": 2\n')
    with pytest.raises(CorpusError, match=r"c\.jsonl, line 3: cannot read '{\"id\": 2'"):
        sources.read_jsonl(spark, str(lines))
    assert sources.read_jsonl(spark, str(lines), strict=False).count() == 1
    assert sources.line_errors(spark, str(lines)).first()["line"] == 3


def test_index_store_and_stream(spark, tmp_path):
    store = index.IndexStore(spark, str(tmp_path / "i"))
    rows = spark.range(5)
    assert store.count() == 0
    store.save(rows)
    store.save(rows, reinit=False)
    assert store.count() == 10
    with pytest.raises(IndexStoreError):
        index.IndexStore(spark).load()
    spark.range(7).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = incremental.stream_of(spark, str(tmp_path / "in"), spark.range(1).schema)
        incremental.append_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_stream_upsert_over_several_batches(spark, tmp_path):
    given = [[(1, 0, "a"), (2, 1, "b"), (1, 2, "c")], [(2, 3, "d"), (None, 4, None)], [(1, 5, None)]]
    for rows in given:  # a file, then a run, as they come; the last run finds nothing new
        spark.createDataFrame(rows, "k int, seq int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            stream = incremental.stream_of(spark, str(tmp_path / "in"), spark.createDataFrame([], "k int, seq int, v string").schema)
            found = incremental.upsert_available(stream, str(tmp_path / "out"), str(tmp_path / "check"), "k", "seq")
    assert {tuple(r) for r in found.select("k", "ordinal", "v").collect()} == {(1, 0, None), (2, 1, "d"), (None, 4, None)}


def test_maxsim_by_equals_maxsim_of_whole_pages(spark):
    rows = spark.createDataFrame([("p", [1.0, 0.0]), ("p", [0.0, 2.0]), ("q", [1.0, 1.0]), ("q", None), ("r", [1.0])], "page string, embedding array<double>")
    found = {r["page"]: r["score"] for r in search.maxsim_by(rows, ["page"], [[1.0, 3.0], [2.0, 0.0]]).collect()}
    assert found == {"p": 8.0, "q": 6.0, "r": None}
    with pytest.raises(ValueError):
        search.maxsim_by(rows, ["page"], [])


def test_reports(spark, tmp_path):
    head = "Type,Name,Request Count,Failure Count,Requests/s,50%,95%,99%\n"
    (tmp_path / "a_stats.csv").write_text(head + "POST,/query,100,2,1.5,10,30,40\nSTAGE,embed,5,0,1,1,2,3\n,Aggregated,105,2,1,1,N/A,3\n")
    (tmp_path / "b_stats.csv").write_text(head + "POST,/query,100,0,1.5,10,45,40\n")
    runs = sources.read_stats(spark, str(tmp_path / "a"), "a").unionByName(sources.read_stats(spark, str(tmp_path / "b"), "b"))
    text = reports.markdown(reports.compared(runs, "a"), "a")
    assert "+15.0 ms (+50.0%)" in text and "2.0%" in text and "n/a" in text and text.index("POST /query") < text.index("STAGE embed") < text.index("### Aggregated")


def test_timings(spark):
    good, bad = json.dumps({"timings_ms": {"embed": 4.0, "generate": 0, "total": 9}}), json.dumps({"timings_ms": {"embed": "x"}})
    rows = spark.createDataFrame([(1, "/q", good), (2, "/q", bad), (3, "/q", "{}")], "k int, e string, b string").withColumn("t", rag.parsed_timings(F.col("b")))
    assert [(r["name"], r["ms"]) for r in rag.stage_events(rows, "e", "t", ["k"]).collect()] == [("/q:embed", 4.0)]


def test_embedders(spark):
    model = embedders.get_embedder("deterministic", dim=4, num_tokens=2)
    a, b = (r["x"] for r in spark.createDataFrame([(b"a",), (b"a",)], "v binary").select(model.column(F.col("v")).alias("x")).collect())
    assert a == b and len(a) == 2 and len(model.embed_query("one two three")) == 3
    with pytest.raises(BackendUnavailableError):
        embedders.get_embedder("ColQwen")
    with pytest.raises(KeyError):
        embedders.get_embedder("nothing")
    colours = embedders.ColourEmbedder()
    pages = spark.createDataFrame([(n, bytes(c) * 16) for n, c in {"red": (220, 20, 20), "green": (20, 200, 20), "blue": (20, 20, 220)}.items()], "file string, pixels binary").withColumn("v", colours.column(F.col("pixels")))
    for word in ("red", "green", "blue"):
        query = vx.multi_vector(colours.embed_query(word).tolist())
        assert search.search(pages, vx.maxsim(query, F.col("v")), 1).first()["file"] == word


def test_settings():
    assert Settings.from_env("T", {"T_TOP_K": "3"}).top_k == 3
    with pytest.raises(ValueError):
        Settings(dpi=0)


def test_human_size_halves(spark):
    from corvane.functions import files as fx

    rows = spark.createDataFrame([(n,) for n in (1280, 1792, 2304, 1023, 1024, -1280, 1024**5 * 3)], "n long").select(fx.human_size(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["1.2 KB", "1.8 KB", "2.2 KB", "1023 B", "1.0 KB", "-1.2 KB", "3.0 PB"]


@pytest.fixture
def corpus(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("red apples\fgreen pears and plums\f \fblue berries")
    (tmp_path / "in" / "b.txt").write_text("motor cars")
    return str(tmp_path / "in")


def test_engine(spark, tmp_path, corpus):
    """Files to pages to an index to ranked results; adding, replacing, filters, unknown formats and an empty index."""
    from corvane import cli
    from corvane.operators import engine, index
    from corvane.operators.filters import Query

    docs = cli.documents(spark, corpus, None).withColumn("meta_topic", F.when(F.col("title") == "b", "cars").otherwise("fruit"))
    own = engine.Engine(embedders.get_embedder("bag"), index.IndexStore(spark, str(tmp_path / "index"))).index(docs)
    assert len(own) == 4 and len(own.index(docs, reinit=False)) == 8 and len(own.index(docs)) == 4
    hits = own.search("green pears and plums", 2).collect()
    assert [(r["filename"], r["page"], r["rank"]) for r in hits][0] == ("a.txt", 2, 1) and hits[0]["normalized_score"] == 1.0 and len(hits) == 2
    only = own.search(Query("green pears").with_filter("topic", "eq", "cars"))
    assert [r["filename"] for r in only.collect()] == ["b.txt"]
    assert {r["score"] for r in engine.annotation(only).collect()} == {r["normalized_score"] for r in only.collect()}
    with pytest.raises(UnsupportedFormatError):
        own.index(docs.withColumn("format", F.lit("pdf")))
    with pytest.raises(EmptyIndexError):
        own.index(docs.limit(0)).search("x")
    multi = engine.Engine(embedders.get_embedder("deterministic", dim=4, num_tokens=2), index.IndexStore(spark, str(tmp_path / "multi"))).index(docs)
    assert [r["rank"] for r in multi.search("anything", 3).collect()] == [1, 2, 3]


def test_ingest_and_manifest(spark, tmp_path, corpus):
    from corvane.operators import engine, keyed
    from corvane.sources import files

    store = keyed.KeyedIndex(spark, str(tmp_path / "passages"), "passage_id")
    rows = lambda *xs: spark.createDataFrame(xs, "passage_id string, text string")
    assert engine.ingest(rows(("a", "one"), ("b", "two")), embedders.BagEmbedder(), store) == 2
    assert engine.ingest(rows(("b", "new"), ("c", "three")), embedders.BagEmbedder(), store) == 2
    assert {(r["passage_id"], r["text"]) for r in store.load().collect()} == {("a", "one"), ("b", "new"), ("c", "three")}
    entries = engine.discovered_entries(files.discover(spark, corpus, with_checksum=True))
    engine.export_manifest(entries, str(tmp_path / "m"), ["checksum"])
    got = engine.load_manifest(spark, str(tmp_path / "m")).collect()
    assert {(r["file"].rsplit("/")[-1], r["pages"], len(r["metadata"]["checksum"])) for r in got} == {("a.txt", 0, 64), ("b.txt", 0, 64)}


def test_command_line(spark, tmp_path, corpus, capsys):
    from corvane import cli
    from corvane.operators import keyed

    assert any("colpali" in x for x in cli.main(["list"]))
    assert cli.main(["index", "--root", corpus, "--index", str(tmp_path / "i")], spark) == ["4 pages"]
    found = cli.main(["search", "--index", str(tmp_path / "i"), "--top-k", "1", "motor cars"], spark)
    assert len(found) == 1 and found[0].startswith("1. [") and "b.txt" in found[0] and found[0] in capsys.readouterr().out
    for name in ("c.TIF", "d.text", "e.TXT", "f"):  # what counts is the suffix, in any case; aliases don't
        (pathlib.Path(corpus) / name).write_text("bicycles")
    assert {r["filename"] for r in cli.documents(spark, corpus, None).collect()} == {"a.txt", "b.txt", "e.TXT"}
    assert {r["filename"] for r in cli.documents(spark, corpus, [".Text"]).collect()} == {"d.text"}
    for name in ("c.TIF", "d.text", "e.TXT", "f"):
        (pathlib.Path(corpus) / name).unlink()
    assert cli.main(["manifest", "--root", corpus, "--out", str(tmp_path / "m")], spark) == ["2 files"]
    (tmp_path / "c.jsonl").write_text(json.dumps({"id": "x", "title": "t", "text": "some words here"}) + "\n")
    assert cli.main(["ingest", "--corpus", str(tmp_path / "c.jsonl"), "--index", str(tmp_path / "p")], spark) == ["1 passages"]
    assert keyed.open_index(spark, str(tmp_path / "p")).count() == 1 and keyed.open_index(spark, str(tmp_path / "i")).count() == 4
    with pytest.raises(SystemExit):
        cli.main(["unknown"])


def test_workflow_with_timings(spark, tmp_path):
    questions = spark.createDataFrame([(1, "red apples", [1.0, 0.0])], "question_id int, question string, q_embedding array<double>")
    passages = spark.createDataFrame([("a", "red apples grow", [0.9, 0.1]), ("b", "cars", [0.1, 0.9])], "passage_id string, text string, embedding array<double>")
    answers, timings = rag.workflow(questions, passages, "query", str(tmp_path / "w"))
    row = answers.first()
    assert row["answer"].startswith("[fake-llm] Context:") and row["passages"] == ["a", "b"] and [*timings] == ["embed", "retrieve", "rerank", "generate", "total"] and all(x > 0 for x in timings.values())
    assert timings["total"] == pytest.approx(sum(x for k, x in timings.items() if k != "total"))
    answers, timings = rag.workflow(questions, passages, "retrieve", str(tmp_path / "w"))
    assert answers.first()["answer"] is None and timings["generate"] == 0.0 and [*timings][-1] == "total"


def test_small_parts(spark):
    from corvane.operators import engine

    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "x map<string,string>, y map<string,string>")
    assert maps.select(engine.merged_metadata(F.col("x"), F.col("y"))).first()[0] == {"a": "1", "b": "3"}
    asked = spark.createDataFrame([(0, "x"), (1, "y")], "index int, text string")
    said = spark.createDataFrame([(1, 0.5), (0, 0.9)], "index int, score double")
    assert [(r["text"], r["score"]) for r in engine.in_input_order(said, asked).collect()] == [("x", 0.9), ("y", 0.5)]
    checks = spark.createDataFrame([("store", True), ("model", False)], "name string, ok boolean")
    assert engine.ready(checks).first().asDict() == {"ready": False, "failing": ["model"]} and engine.ready(checks.limit(0)).first()["ready"]
    assert json.loads(spark.range(1).select(engine.log_line("search", n=F.col("id"))).first()[0]) == {"event": "search", "n": 0}
    assert engine.Timings({"index": 500.0}).throughput("index", 100) == 200 and engine.Timings({}).throughput("x", 1) == 0
    one = spark.createDataFrame([(bytes(range(9)), 3, 1)], "p binary, w int, h int").select(engine.image_key(F.col("p"), F.col("w"), F.col("h"))).first()[0]
    assert bytes(one) == b"img:3x1:" + bytes(range(9))


def bitmap(width, height, colour):
    """A BMP of one colour (red, green, blue)."""
    row = bytes(colour[::-1]) * width + bytes(-3 * width % 4)
    head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(row) * height, 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(row) * height, 0, 0, 54) + head + row * height


def test_images_and_gold(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "a.bmp").write_bytes(bitmap(3, 2, (255, 51, 0)))
    (tmp_path / "images" / "broken.bmp").write_bytes(b"BM nothing")
    pages = sources.read_images(spark, str(tmp_path / "images"))
    row = pages.select("file", "page", "width", "height", sources.mean_colour(F.col("pixels")).alias("c")).collect()
    assert [(r["file"].rsplit("/")[-1], r["page"], r["width"], r["height"], [round(x, 6) for x in r["c"]]) for r in row] == [("a.bmp", 1, 3, 2, [1.0, 0.2, 0.0])]
    (tmp_path / "gold.json").write_text(json.dumps([{"ranked": ["a", "b"], "relevant": ["b"]}, {"ranked": [], "relevant": ["c"]}]))
    ranked, relevant, queries = metrics.from_gold(sources.read_gold(spark, str(tmp_path / "gold.json")))
    report = metrics.macro(metrics.per_query(ranked, relevant, queries, 5)).first()
    assert report["queries"] == 2 and report["recall"] == 0.5 and report["mrr"] == 0.25


def test_strict_zip_scorers_and_questions(spark):
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "ordinal int")
    assert index.zipped(rows(0, 1), rows(1, 0), strict=True).count() == 2
    with pytest.raises(Exception, match="differ in length"):
        index.zipped(rows(0, 1), rows(0), strict=True).collect()
    assert vx.scorer() is vx.cosine and vx.scorer(multi=True) is vx.maxsim and vx.scorer("dot") is vx.dot
    assert one(spark, fx.zoom(F.lit(144))) == 2.0
    asked = sources.synthetic_questions(spark, 12).orderBy("question_id").collect()
    assert asked[0]["question"] == asked[10]["question"] == f"What is the rule on {sources.TOPICS[0]}?" and len({r["question"] for r in asked}) == 10


@pytest.mark.parametrize("cosine", [False, True])
def test_product_topk_is_search_batch(spark, cosine, monkeypatch):
    """Ties, equal and null vectors, unequal lengths, empty tables, several blocks and batches."""
    vectors = [[1.0, 0.0], [1.0, 0.0], [0.5, 0.5], [-1.0, 2.0], [0.0, 0.0], None, [1.0, None], [1.0, float("nan")], [3.0], [1.0, 0.0]]
    rows = spark.createDataFrame([(k % 9, f"t{k}", v) for k, v in enumerate(vectors)], "id int, tag string, v array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.3, 0.7]), (3, [2.0]), (4, None), (5, [1.0, 2.0, 3.0])], "query int, q array<double>")
    scored = F.round((vx.cosine if cosine else vx.dot)(F.col("v"), F.col("q")), 6)
    ways = lambda df: {tuple(r) for r in df.select("query", "id", "tag", "score", "rank").collect()}
    for at_once, size in ((1, 1 << 26), (256, 8)):
        monkeypatch.setattr(search, "AT_ONCE", at_once)
        monkeypatch.setattr(search, "QUERY_BYTES", size)
        for k in (0, 2, 20):
            got = search.product_topk(rows, asked, "query", "v", "q", k, {"id": {"lt": 8}}, ["id", "tag"], cosine, 6)
            assert ways(got) == ways(search.search_batch(rows, asked, scored, "query", k, {"id": {"lt": 8}}, ["id", "tag"]))
    assert search.product_topk(rows.limit(0), asked, "query", "v", "q").count() == search.product_topk(rows, asked.limit(0), "query", "v", "q").count() == 0


def test_maxsim_topk_is_maxsim_of_pairs(spark, monkeypatch):
    """Ragged pages, null and odd vectors, several lengths, queries without vectors, small slices."""
    pages = [[[1.0, 0.0], [0.0, 2.0]], [[0.5, 0.5]], [], None, [None, [3.0, 1.0]], [[1.0, None], [1.0, 1.0]], [[2.0]], [[2.0], [1.0, 1.0], [-1.0, -1.0]], [[float("nan"), 1.0]], [[1.0, 0.0]] * 7, [[-5.0, -5.0]]]
    rows = spark.createDataFrame([(k % 10, f"t{k}", v) for k, v in enumerate(pages)], "id int, tag string, d array<array<double>>").repartition(3)
    asked = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]), (2, [[1.0, 1.0], [2.0]]), (3, []), (4, None), (5, [None, [1.0, 1.0]]), (6, [[1.0, None]]), (7, [[-1.0, 0.5]]), (8, [[1.0, 2.0, 3.0]])], "query int, q array<array<double>>")
    scored = F.round(vx.maxsim(F.col("q"), F.col("d")), 6)
    ways = lambda df, *more: {tuple(r) for r in df.select("query", "id", "tag", "score", "rank", *more).collect()}
    for products, at_once, size in ((1 << 22, 256, 1 << 26), (4, 2, 16)):
        monkeypatch.setattr(search, "PRODUCTS", products)
        monkeypatch.setattr(search, "AT_ONCE", at_once)
        monkeypatch.setattr(search, "QUERY_BYTES", size)
        for k in (2, 20):
            got = search.maxsim_topk(rows, asked, "query", "d", "q", k, {"id": {"lt": 9}}, ["id", "tag"], 6)
            assert ways(got) == ways(search.search_batch(rows, asked, scored, "query", k, {"id": {"lt": 9}}, ["id", "tag"]))
    assert search.maxsim_topk(rows.limit(0), asked, "query", "d", "q").count() == search.maxsim_topk(rows, asked.limit(0), "query", "d", "q").count() == 0
    every = {q: sorted((r for r in search.search_batch(rows, asked.where(f"query = {q}"), scored, "query", 99).collect()), key=lambda r: (-r["score"], r["id"], r["tag"])) for q in range(1, 9)}
    got = search.maxsim_topk(rows, asked, "query", "d", "q", 3, {"id": {"lt": 6}}, ["id", "tag"], 6, normalized=True).collect()
    for q, all_ in every.items():
        low, high = (min(x["score"] for x in all_), max(x["score"] for x in all_)) if all_ else (0, 0)
        wanted = [(r["id"], r["tag"], pytest.approx((r["score"] - low) / (high - low) if high > low else 0)) for r in all_ if r["id"] < 6][:3]
        assert [(r["id"], r["tag"], r["normalized_score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] == wanted


def test_normalised_batch_search_reads_the_index_once(spark, tmp_path):
    spark.createDataFrame([(k, k % 3, [float(k), 1.0]) for k in range(50)], "id int, label int, v array<double>").write.parquet(str(tmp_path / "i"))
    rows = spark.read.parquet(str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query int, q array<double>")
    found = search.product_topk(rows, asked, "query", "v", "q", 2, {"label": 1}, ["id"], normalized=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert [(r["query"], r["id"], round(r["normalized_score"], 6)) for r in found.orderBy("query", "rank").collect()] == [(1, 49, 1.0), (1, 46, round(46 / 49, 6)), (2, 1, round(48 / 49, 6)), (2, 4, round(45 / 49, 6))]
    none = search.product_topk(rows, asked, "query", "v", "q", 0, normalized=True)
    assert none.count() == 0


def test_sketches_merge_and_keep_their_rank_error(spark):
    import random

    rng = random.Random(9)
    values = [(k % 7, k % 2, rng.lognormvariate(0, 2)) for k in range(60_000)]
    df = spark.createDataFrame(values, "part int, side int, v double").repartition(5)
    small = reports.sketched(df, ["side", "part"], "v", 1024)
    rows = reports.quantiles(reports.merged(small, ["side"])).collect()
    for r in rows:
        own = sorted(v for _, s, v in values if s == r["side"])
        assert r["requests"] == len(own)
        for name, q in reports.QUANTILES.items():
            at = sum(v <= r[name] for v in own) / len(own)
            assert abs(at - q) <= 0.01 and r[name] in own
    odd = spark.createDataFrame([("a", None), ("b", 1.0), ("b", None), ("b", 3.0)], "k string, v double")
    assert {tuple(r) for r in reports.latencies(odd, ["k"], "v").collect()} == {("a", 1, None, None, None), ("b", 3, 1.0, 3.0, 3.0)}
    assert {tuple(r)[:3] for r in reports.latencies(odd, ["k"], "v", exact=True).collect()} == {("a", 1, None), ("b", 3, 2.0)}
    assert reports.latencies(odd.limit(0), ["k"], "v").count() == 0


def test_lines_are_numbered_by_split(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = {"a.jsonl": [json.dumps({"id": str(k), "title": "t", "text": "x" * (k % 50)}) if k % 97 else "broken" for k in range(1, 3000)], "b.jsonl": ["", "{}", "", json.dumps({"id": "z", "title": "t", "text": ""})]}
    for name, lines in texts.items():
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4096", was):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = sources.numbered_lines(spark, str(tmp_path / "in"))
            splits = spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions()
            assert splits > 20 if size == "4096" else splits < 5
            assert {(r["file"].rsplit("/")[-1], r["line"], r["value"]) for r in rows.collect()} == {(n, k, x) for n, xs in texts.items() for k, x in enumerate(xs, 1)}
            bad = sources.line_errors(spark, str(tmp_path / "in")).collect()
            assert sorted((r["file"].rsplit("/")[-1], r["line"]) for r in bad) == [*(("a.jsonl", k) for k in range(97, 3000, 97)), ("b.jsonl", 2)]
            good = sources.read_jsonl(spark, str(tmp_path / "in"), strict=False, numbered=True).where("id = 'z' or id = '2998'").collect()
            assert sorted((r["file"].rsplit("/")[-1], r["line"]) for r in good) == [("a.jsonl", 2998), ("b.jsonl", 4)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    with pytest.raises(CorpusError, match="a.jsonl, line 97: cannot read 'broken'"):
        sources.read_jsonl(spark, str(tmp_path / "in"))


@pytest.mark.parametrize("ties", [False, True])
def test_deep_pages(spark, ties):
    import random

    rng = random.Random(3)
    rows = [(rng.choice([None, 5.0, 5.0, float(rng.randrange(4000)), float("nan")]) if ties else float(k * 7919 % 5003), k) for k in range(5000)]
    df = spark.createDataFrame(rows, "a double, b int").repartition(4)
    key = lambda r: (r[0] is not None, r[0] is not None and r[0] != r[0], r[0] if r[0] is not None and r[0] == r[0] else 0, r[1])
    wanted = sorted(rows, key=key)
    for offset, limit in ((0, 5), (1700, 20), (2500, 7), (4990, 40), (6000, 3)):
        got = [tuple(r) for r in search.page_of(df, ["a", "b"], offset, limit, shallow=100).collect()]
        assert repr(got) == repr(wanted[offset : offset + limit])
    held = search.page_of(df, ["a", "b"], 4000, 10, shallow=100)
    limits = re.findall(r"TakeOrderedAndProject\(limit=(\d+)", held._jdf.queryExecution().executedPlan().toString())
    assert limits and max(map(int, limits)) <= 110
    same = spark.createDataFrame([(1.0, 1)] * 900, "a double, b int")
    assert len(search.page_of(same, ["a"], 700, 5, shallow=50).collect()) == 5


def test_numbered_with_a_repeated_key(spark, monkeypatch):
    """A key that most rows have still leaves edges between the others."""
    from corvane.operators import numbering

    monkeypatch.setattr(numbering, "SAMPLED", 2)
    rows = [("g", 50)] * 3000 + [("g", k) for k in range(100)]
    df = spark.createDataFrame(rows, "g string, k int")
    got = numbering.numbered(df, "g", "k", "n").collect()
    assert sorted(r["n"] for r in got) == [*range(1, 3101)]
    assert [r["k"] for r in sorted(got, key=lambda r: r["n"])] == sorted(k for _, k in rows)
    assert df.select(numbering._part(df, "k").alias("p")).distinct().count() > 10


def test_compression_empty_scores_and_image_keys(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    for name, wanted in (("zstd", "ZSTD"), ("none", "UNCOMPRESSED")):
        store = index.IndexStore(spark, str(tmp_path / name), name)
        store.save(spark.createDataFrame([(k, [[1.0] * (k % 3), []]) for k in range(9)], "id int, v array<array<double>>"))
        files = glob.glob(f"{tmp_path}/{name}/*.parquet")
        assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {wanted}
        assert {(r["id"], repr(r["v"])) for r in store.load().collect()} == {(k, repr([[1.0] * (k % 3), []])) for k in range(9)}
    none = spark.createDataFrame([], "k int, score double")
    assert search.minmax(none).collect() == search.minmax(none, by=["k"]).collect() == []
    nothing = spark.createDataFrame([(1, [], [])], "id int, pages array<int>, raw array<double>")
    assert search.from_arrays(nothing, "id", "pages", "raw").count() == 0
    own = embedders.get_embedder("deterministic", dim=4, num_tokens=2)
    image = spark.createDataFrame([(bytes(range(12)), 2, 2)], "p binary, w int, h int")
    by_size = image.select(own.column(own.of_image(F.col("p"), F.col("w"), F.col("h"))).alias("e")).first()["e"]
    assert by_size == [v.tolist() for v in own.embed([b"img:2x2:" + bytes(range(12))])[0]]


def test_history_by_segments(spark, monkeypatch):
    monkeypatch.setattr(rag, "SEGMENT", 4)
    turns = [("c", k * 7 % 30, "user" if k % 3 else "assistant", f"t{k}" if k % 5 else None) for k in range(30)] + [("c", 3, "user", "again"), ("d", 1, "user", None), ("e", None, "user", "x"), ("e", 0, "user", "")]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    wanted = {}
    for c, turn, _, text in sorted((t for t in turns if t[2] == "user"), key=lambda t: (t[1] is not None, t[1] or 0, t[3] is not None, t[3] or "")):
        wanted.setdefault(c, []).extend([] if text is None else [text])
    assert {r["conv_id"]: r["history"] for r in rag.history(df).collect()} == {c: "\n".join(x) for c, x in wanted.items()}


def test_numbered_is_a_window(spark, monkeypatch):
    """A group with most rows, null groups and keys, repeated keys, strings and dates, an empty table."""
    from pyspark.sql import Window

    from corvane.operators import numbering

    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("s"), F.col("id") % 7)).alias("s"), F.when(F.col("id") % 500 > 0, F.col("id") * 7919 % 3001).alias("k"))
    typed = rows.withColumns({"name": F.concat(F.lit("n"), F.col("k").cast("string")), "day": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("k") % 900).cast("int"))})
    for sampled in (numbering.SAMPLED, 2):
        monkeypatch.setattr(numbering, "SAMPLED", sampled)
        for order in ("k", "name", "day"):
            found = numbering.numbered(typed, "s", order, "n").select("s", order, "n")
            window = F.row_number().over(Window.partitionBy("s").orderBy(order)).cast("long").alias("n")
            assert sorted(map(repr, found.collect())) == sorted(map(repr, typed.select("s", order, window).collect()))
    assert numbering.numbered(typed.limit(0), "s", "k", "n").count() == 0
    hot = typed.where("s = 'hot'").withColumn("part", numbering._part(typed, "k")).groupBy("part").count().collect()
    assert len(hot) > 20 and max(r["count"] for r in hot) < 400
