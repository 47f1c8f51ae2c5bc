"""The round trip of op1: one Python worker a task, and the same as its two halves."""

import hashlib

import pytest

from corvane.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "a", "it's 中文 \x00 x" * 900, "x" * 5000, "  \n", "", None]
    return spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string")


def test_a_round_trip_takes_one_worker_a_task(odd):
    plan = bpe.digests(odd, PATH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_round_trip_is_encode_then_decode(odd):
    tokens = bpe.encode(odd, PATH).selectExpr("*", "ids as kept")
    rows = sorted((r["doc_id"], r["kept"], bytes(r["decoded"])) for r in bpe.decode(tokens, PATH, ("doc_id", "kept")).collect())
    assert rows == sorted((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in bpe.round_trip(odd, PATH).collect())
    assert sorted(b for _, _, b in rows) == sorted((r["text"] or "").encode() for r in odd.collect())
    wanted = sorted((k, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(b).hexdigest()) for k, i, b in rows)
    assert sorted(map(tuple, bpe.digests(odd, PATH).collect())) == wanted


def test_lists_that_disagree_fail_and_null_lists_are_empty(spark):
    nulls = spark.createDataFrame([(1, None, None), (2, [], []), (3, [64], [1])], "doc_id long, ids array<int>, ends array<int>")
    token = bpe.vocabulary(PATH).token[64]
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(nulls, PATH).collect()) == [(1, b""), (2, b""), (3, token)]
    wrong = spark.createDataFrame([(1, [64, 65], [1, 9])], nulls.schema)
    with pytest.raises(Exception, match="disagree"):
        bpe.decode(wrong, PATH).collect()
