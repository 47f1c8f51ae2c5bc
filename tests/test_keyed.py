"""The keyed index: what a batch writes, what a broken run leaves, and what is read."""

import os
import random

import pytest

from corvane.errors import IndexStoreError
from corvane.operators import keyed


def rows(spark, *xs):
    return spark.createDataFrame(xs, "k long, v string").coalesce(1)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path / "data") for f in names if f.endswith(".parquet")}


def found(store, number=None):
    return {r["k"]: r["v"] for r in store.load(number).collect()}


def test_a_batch_writes_only_the_buckets_that_it_touches(spark, tmp_path):
    store = keyed.KeyedIndex(spark, str(tmp_path), "k", buckets=16)
    assert not store.exists() and store.count() == 0
    assert store.upsert(rows(spark, *((k, "old") for k in range(400)))) == 400
    first = files(tmp_path)
    assert len(first) == 16
    assert store.upsert(rows(spark, (7, "new"), (400, "new"))) == 2
    after = files(tmp_path)
    assert len(after.keys() - first.keys()) <= 2 and all(after[f] == t for f, t in first.items())
    assert found(store) == {**dict.fromkeys(range(400), "old"), 7: "new", 400: "new"}
    assert sum(len(p) > 1 for p in store.version()["parts"].values()) in (1, 2)


def test_only_buckets_of_several_parts_are_merged(spark, tmp_path):
    store = keyed.KeyedIndex(spark, str(tmp_path), "k", buckets=8)
    store.upsert(rows(spark, *((k, "a") for k in range(100))))
    assert "Exchange" not in store.load()._jdf.queryExecution().toString()
    store.upsert(rows(spark, (1, "b")))
    assert "Exchange" in store.load()._jdf.queryExecution().toString()
    assert store.compact() == [b for b, p in sorted(store.version(2)["parts"].items()) if len(p) > 1] != []
    assert "Exchange" not in store.load()._jdf.queryExecution().toString() and found(store)[1] == "b"


def test_the_last_row_of_a_key_counts_within_a_batch_and_its_first_place_stays(spark, tmp_path):
    store = keyed.KeyedIndex(spark, str(tmp_path), "k")
    assert store.upsert(rows(spark, (1, "one"), (2, "x"), (1, "two"), (None, "n"), (None, None))) == 5
    assert found(store) == {1: "two", 2: "x", None: None}
    store.upsert(rows(spark, (3, "y"), (1, "three")))
    assert {r["k"]: r["ordinal"] for r in store.load().collect()} == {1: 1, 2: 1, None: 1, 3: 2}


def test_a_run_that_breaks_off_changes_nothing_and_can_come_again(spark, tmp_path, monkeypatch):
    store = keyed.KeyedIndex(spark, str(tmp_path), "k", buckets=4)
    store.upsert(rows(spark, (1, "a"), (2, "a")), batch=0)
    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedIndex, "_commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert(rows(spark, (1, "b"), (3, "b")), batch=1)
    assert found(store) == {1: "a", 2: "a"}
    assert store.upsert(rows(spark, (1, "b"), (3, "b")), batch=1) == 2
    assert store.upsert(rows(spark, (1, "b"), (3, "b")), batch=1) == 0  # it was here before
    assert found(store) == {1: "b", 2: "a", 3: "b"} and found(store, 1) == {1: "a", 2: "a"}
    before = len(files(tmp_path))
    assert store.vacuum(keep=1) == 1 and len(files(tmp_path)) < before  # what the lost run had written
    assert found(store) == {1: "b", 2: "a", 3: "b"} and store.versions() == [2]


def test_two_writers_of_one_version(spark, tmp_path):
    store = keyed.KeyedIndex(spark, str(tmp_path), "k")
    store.upsert(rows(spark, (1, "a")))
    now = store.version()
    store.upsert(rows(spark, (1, "b")))
    with pytest.raises(IndexStoreError, match="another"):
        store._commit(now)
    assert found(store) == {1: "b"}


def test_many_random_batches_with_merging(spark, tmp_path):
    rng, wanted, first = random.Random(5), {}, {}
    store = keyed.KeyedIndex(spark, str(tmp_path), "k", buckets=3, max_parts=2)
    seqs = rng.sample(range(10_000), 200)
    for n in range(5):
        given = [(rng.randrange(30), s, f"v{s}") for s in seqs[n * 40 : n * 40 + 40]]
        store.upsert(spark.createDataFrame(given, "k long, seq long, v string"), "seq", n)
        for k, s, v in given:
            wanted[k], first[k] = max(wanted.get(k, (-1, "")), (s, v)), min(first.get(k, s), s)
        assert max(len(p) for p in store.version()["parts"].values()) <= 2
    assert {r["k"]: (r["ordinal"], r["v"]) for r in store.load().collect()} == {k: (first[k], v) for k, (_, v) in wanted.items()}


def test_replacing_clearing_and_other_columns(spark, tmp_path):
    store = keyed.KeyedIndex(spark, str(tmp_path), "k")
    store.save(rows(spark, (1, "a"), (2, "b"), (2, "c")))
    store.save(rows(spark, (3, "d")), reinit=False)
    assert found(store) == {1: "a", 2: "c", 3: "d"}
    with pytest.raises(IndexStoreError, match="columns"):
        store.upsert(spark.createDataFrame([(1, 2)], "k long, w int"))
    store.save(rows(spark, (9, "z")))
    assert found(store) == {9: "z"}
    store.clear(rows(spark).schema)
    assert store.count() == 0 and store.upsert(rows(spark)) == 0
    assert isinstance(keyed.open_index(spark, str(tmp_path)), keyed.KeyedIndex)
