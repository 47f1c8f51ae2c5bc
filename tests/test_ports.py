"""Calls to models and stores: order of answers, tries, and what goes wrong; services, events, versions."""

import random
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corvane import errors
from corvane.operators import embedders, engine, index, ports
from corvane.operators.keyed import KeyedIndex
from corvane.session import Settings, configure_logging, is_local


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks don't have this module


class Shuffled:
    """Answers in any order; the first call of each request fails, if told so."""

    def __init__(self, fail=0, error=ConnectionError):
        self.fail, self.error, self.failed = fail, error, {}

    def _lost(self, rows):
        key = repr(rows)
        self.failed[key] = self.failed.get(key, 0) + 1
        if self.failed[key] <= self.fail:
            raise self.error("gone")

    def score(self, pairs):
        self._lost(pairs)
        out = [(k, float(len(text) - len(query))) for k, (query, text) in enumerate(pairs)]
        random.Random(3).shuffle(out)
        return out

    def generate(self, chats):
        self._lost(chats)
        out = [(k, "|".join(m["role"] + ":" + m["content"] for m in chat)) for k, chat in enumerate(chats)]
        random.Random(4).shuffle(out)
        return out


class Folder:
    """A store that driver and tasks see: a file a row."""

    def __init__(self, path):
        self.path = str(path)

    def upsert(self, rows):
        import json
        import os

        for r in rows:
            with open(os.path.join(self.path, f"{r['key']}.json"), "w") as f:
                json.dump(r, f)

    def _rows(self):
        import glob
        import json

        return [json.load(open(p)) for p in glob.glob(self.path + "/*.json")]

    def query(self, vectors, k):
        rows = self._rows()
        for n in reversed(range(len(vectors))):
            scored = sorted(((-sum(a * b for a, b in zip(r["v"], vectors[n])), r["key"]) for r in rows))[:k]
            yield n, [(key, -s) for s, key in scored]

    def count(self):
        return len(self._rows())


QUICK = ports.Calls(size=3, tries=2, wait=0.0)


def candidates(spark):
    rows = [(q, "ab", k, "x" * ((k * 7 + q) % 11), k) for q in (1, 2) for k in range(1, 9)] + [(3, "ab", 1, None, 1)]
    return spark.createDataFrame(rows, "q int, question string, p int, text string, rank int").repartition(3)


@pytest.mark.parametrize("fail", [0, 1])
def test_reranking_puts_answers_back_in_order(spark, fail):
    got = ports.reranked(candidates(spark), Shuffled(fail), 3, ["q"], calls=QUICK).collect()
    for q in (1, 2):
        wanted = sorted(range(1, 9), key=lambda k: (-((k * 7 + q) % 11), k))[:3]
        assert [r["p"] for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == wanted
        assert all(r["rerank_score"] == (r["p"] * 7 + q) % 11 - 2 for r in got if r["q"] == q)
    assert [r["rerank_score"] for r in got if r["q"] == 3] == [-2.0]


def test_a_failure_that_stays_names_its_kind(spark):
    with pytest.raises(errors.DependencyError) as e:
        QUICK.answers(Shuffled(9, TimeoutError).score, [("a", "b")])
    assert e.value.kind == "timeout" and "after 2 tries" in str(e.value)
    with pytest.raises(Exception, match="unavailable: after 2 tries: gone"):
        ports.reranked(candidates(spark), Shuffled(9), 3, ["q"], calls=QUICK).collect()
    for wrong in ([(0, 1.0)], [(0, 1.0), (0, 2.0)], [(0, 1.0), (5, 1.0)], [(0, 1.0), (1, 1.0), (1, 1.0)]):
        with pytest.raises(errors.DependencyError, match="answered"):
            QUICK.answers(lambda rows, wrong=wrong: wrong, ["a", "b"])
    with pytest.raises(ValueError):
        QUICK.answers(lambda rows: (_ for _ in ()).throw(ValueError("a fault of ours")), ["a"])
    for bad in ({"size": 0}, {"tries": 0}, {"wait": -1.0}):
        with pytest.raises(ValueError):
            ports.Calls(**bad)
    with pytest.raises(ValueError):
        errors.DependencyError("x", "other")


def test_chat_models_and_other_calls(spark):
    hits = spark.createDataFrame([(1, "why", 1, "first"), (1, "why", 2, "second"), (2, "how", 1, "third")], "question_id int, question string, rank int, text string")
    got = {r["question_id"]: r["answer"] for r in ports.generated(ports.conversation(hits), Shuffled(1), calls=QUICK).collect()}
    assert got[1].startswith("system:") and "[1] first\n[2] second" in got[1] and "Question: how" in got[2]
    nothing = spark.createDataFrame([(1, None), (2, [])], "id int, messages array<struct<role: string, content: string>>")
    assert [r["answer"] for r in ports.generated(nothing, Shuffled(), calls=QUICK).collect()] == ["", ""]
    backwards = lambda rows: [(k, str(rows[k])[::-1]) for k in reversed(range(len(rows)))]
    found = spark.range(10).select("id", ports.column(backwards, F.col("id") + 10, "string", QUICK).alias("x")).collect()
    assert all(r["x"] == str(r["id"] + 10)[::-1] for r in found)
    assert isinstance(Shuffled(), ports.Reranker) and isinstance(Shuffled(), ports.ChatModel) and isinstance(Folder("x"), ports.VectorStore)


def test_stores_inside_and_outside_of_spark_say_the_same(spark, tmp_path):
    (tmp_path / "out").mkdir()
    outside, inside = Folder(tmp_path / "out"), ports.SparkStore(KeyedIndex(spark, str(tmp_path / "in"), "key"), "v")
    rows = spark.createDataFrame([(f"k{n}", [float(n % 5), float(n % 3)]) for n in range(20)], "key string, v array<double>").repartition(4)
    assert inside.count() == 0
    for _ in range(2):
        assert ports.sent(rows, outside, QUICK) == inside.upsert(rows) == 20
    assert outside.count() == inside.count() == 20
    asked = spark.createDataFrame([(1, [1.0, 0.5]), (2, [-1.0, 2.0]), (3, None)], "query_id int, vector array<double>")
    ways = lambda df, key: {tuple(r) for r in df.select("query_id", key, F.round("score", 9), "rank").collect()}
    assert ways(ports.found(asked, outside, 4, calls=QUICK), "key") == ways(inside.query(asked, 4), "key")
    assert ports.found(asked.limit(0), outside, 4).count() == 0 and ports.sent(rows.limit(0), outside) == 0


def test_services_tell_how_long_they_took(spark, tmp_path):
    docs = spark.createDataFrame([("d", "v", "a.txt", "txt", b"red apples\fgreen pears"), ("e", "w", "b.txt", "txt", b"motor cars")], "doc_id string, version_id string, file string, format string, content binary")
    own = engine.Engine(embedders.get_embedder("bag"), index.IndexStore(spark, str(tmp_path / "i")))
    pages, took = engine.IndexService(own).execute(docs)
    assert pages == 3 and took > 0
    found = engine.SearchService(own).execute("motor cars", 2)
    assert [r["file"] for r in found.hits][0] == "b.txt" and len(found.hits) == 2 and found.took_ms > 0 and found.query.text == "motor cars"
    for blank in ("", " \n"):
        with pytest.raises(errors.EmptyQueryError):
            engine.SearchService(own).execute(blank)


def test_events_versions_logging_and_masters(spark, capsys):
    row = spark.range(1).select(engine.event("DocumentIndexed", pages=F.col("id") + 3).alias("e")).first()["e"]
    assert row["event_type"] == "DocumentIndexed" and row["pages"] == 3
    at = datetime.fromisoformat(row["occurred_at"])
    assert abs((datetime.now(at.tzinfo) - at).total_seconds()) < 600 and at.utcoffset().total_seconds() == 0
    files = spark.createDataFrame([("x/a.tif", "tiff")], "path string, format string")
    version = engine.document_versions(files).first()
    assert version["checksum"] is None and version["document_metadata"] == {"format": "tiff"} and version["title"] == "a" and version["doc_id"].startswith("doc_")
    import logging

    root = logging.getLogger()
    was = root.level, list(root.handlers)
    try:
        configure_logging("warning")
        assert root.level == logging.WARNING
        logging.getLogger("some.part").warning("said")
        assert "WARNING  some.part: said" in capsys.readouterr().err
        with pytest.raises(errors.ConfigurationError):
            configure_logging("loud")
    finally:
        root.setLevel(was[0])
        root.handlers[:] = was[1]
    with pytest.raises(errors.ConfigurationError):
        Settings(dpi=0)
    assert [is_local(m) for m in ("local", "local[4]", "local-cluster[2,1,1024]", "spark://x:7077")] == [True, True, False, False]
