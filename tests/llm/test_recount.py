"""What the second pass of op12 sends on: counts of many terms in a row, and only of terms that the language keeps."""

from collections import Counter

import numpy as np
import pyarrow as pa

from corvane.llm import divergence
from corvane.llm.divergence import WIDTH


def unpacked(batches):
    out, rows = Counter(), 0
    for batch in batches:
        for r in batch.to_pylist():
            rows += 1
            for k, n in zip(np.frombuffer(r["places"], np.uint16).tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True):
                out[r["lang"], r["source"], r["part"] * WIDTH + k] += n
    return out, rows


def test_counts_of_many_terms_leave_a_task_in_a_row():
    n, groups = 5 * WIDTH + 7, [("en", "a"), ("en", ""), ("", "a"), ("xx", "a")]
    kept = np.sort(np.concatenate([np.arange(n), (1 << 32) + np.arange(0, n, 2)]))
    sums, rng, wanted, sent = divergence._Groups(["en", ""], kept), np.random.default_rng(1), Counter(), []
    for k in range(40):
        group, places = groups[k % 4], rng.integers(0, n, 3000)
        wanted.update((*group, p) for p in places.tolist() if group[0] == "en" or group[0] == "" and p % 2 == 0)
        sent += sums.add(group, places)
    found, rows = unpacked([*sent, *sums.rest()])
    assert found == wanted and rows == 3 * 6
    assert unpacked(sums.rest()) == (Counter(), 0)


def test_counts_that_leave_a_task_more_than_once_add_up(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    sums, wanted, sent = divergence._Groups(["en"], np.arange(400)), Counter(), []
    for k in range(60):
        places = np.arange(k, 400, 7)
        wanted.update(("en", str(k % 3), p) for p in places.tolist())
        sent += sums.add(("en", str(k % 3)), places)
    assert len(sent) > 5 and unpacked([*sent, *sums.rest()])[0] == wanted


def test_a_row_of_terms_goes_on_from_batch_to_batch(spark):
    """More partial counts of the same terms than are summed at once, in a plan without a join by term."""
    words = ["".join(chr(97 + int(c)) for c in f"{k:04d}") for k in range(WIDTH)]
    parts = divergence.COUNTS_BYTES // (2 * WIDTH) + 20
    text = " ".join(words)
    texts = spark.range(0, parts, 1, parts).selectExpr("'en' as lang", "case when id % 50 = 0 then 's' else 't' end as source", f"'{text} {words[3]}' as text")
    kept = spark.createDataFrame([("en", w) for w in words] + [("xx", words[0]), ("xx", "other")], "lang string, term string")
    found = divergence.occurrences(texts, kept)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    few = -(-parts // 50)
    wanted = {("en", s, w): n * (1 + (w == words[3])) for s, n in (("s", few), ("t", parts - few)) for w in words}
    rows = found.collect()
    assert len(rows) == len(wanted) and {(r["lang"], r["source"], r["term"]): r["n"] for r in rows} == wanted


def test_names_of_languages_are_bounded_as_terms_are(spark):
    langs = ["l" * 40 + str(k) for k in range(12)]
    texts = spark.createDataFrame([(x, "s", "ab cd ab") for x in langs], "lang string, source string, text string")
    kept = spark.createDataFrame([(x, w) for x in langs for w in ("ab", "cd")], "lang string, term string")
    once, often = (divergence.occurrences(texts, kept, n) for n in (4000, 500))
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert often._jdf.queryExecution().executedPlan().toString().count("MapInArrow") > 0
    wanted = sorted([(x, "s", w, n) for x in langs for w, n in (("ab", 2), ("cd", 1))])
    assert sorted(map(tuple, once.collect())) == wanted == sorted(map(tuple, often.collect()))


def test_empty_rows_of_bytes():
    assert divergence._rows(np.zeros(0, np.int64), np.zeros(1, np.int64)).to_pylist() == [b""]
    assert divergence._rows(np.array([1, 2, 3], np.uint16), np.array([0, 2])).type == pa.binary()


def test_further_scans_read_the_texts_of_their_languages_only(spark):
    assert divergence.scans_of({"a": 25, "b": 4, "c": 6, "d": 5, "e": 3}, 10) == [(["a"], 3), (["c"], 1), (["d", "b"], 1), (["e"], 1)]
    assert divergence.scans_of({}, 10) == []
    texts = spark.createDataFrame([("en", "s", "ab cd ab"), ("de", "s", "ab ef"), ("fr", "s", "ab gh"), ("xx", "s", "ab")], "lang string, source string, text string")
    kept = spark.createDataFrame([(x, w) for x in ("en", "de", "fr") for w in ("ab", "cd", "ef", "gh")], "lang string, term string")
    found = divergence.occurrences(texts, kept, 16)  # the terms of one language
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 6 and all(plan.count(f"= {x})") == 1 for x in ("en", "de", "fr"))
    assert sorted(map(tuple, found.collect())) == [("de", "s", "ab", 1), ("de", "s", "ef", 1), ("en", "s", "ab", 2), ("en", "s", "cd", 1), ("fr", "s", "ab", 1), ("fr", "s", "gh", 1)]
