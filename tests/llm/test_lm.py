"""Deleted interpolation beside a plain model of dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from corvane.llm import lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def plain(rows, rounds=12):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of (doc_id, text)."""
    cls = lambda i: 2 if i is None else min(zlib.crc32(str(i).encode()) % 10, 2)
    counts = {k: [Counter(), Counter(), Counter()] for k in (1, 2)}
    for i, text in rows:
        if (c := cls(i)) in counts:
            s = ["<s>", "<s>", *tokens(text)]
            for k, grams in enumerate((s[1:], zip(s, s[1:]), zip(s, s[1:], s[2:]))):
                counts[c][k].update(grams)
    whole = [counts[1][k] + counts[2][k] for k in range(3)]
    kinds, size = len(whole[0].keys() - {"<s>"}), lambda c: sum(c[0].values()) - c[0]["<s>"]

    def estimates(c, total, u, v, w):
        pair, word = c[1][u, v], c[0][v]
        bucket = (2, pair.bit_length()) if pair else (1, word.bit_length()) if word else (0, 0)
        return bucket, [1 / (kinds + 1), *([c[0][w] / total] if total else []), *([c[1][v, w] / word] if word else []), *([c[2][u, v, w] / pair] if pair else [])]

    seen = [(*estimates(counts[2], size(counts[2]), *gram), n) for gram, n in counts[1][2].items()]
    weights = {}
    for _ in range(rounds):
        expected = {}
        for bucket, p, n in seen:
            x = [a * b for a, b in zip(weights.get(bucket, [1 / len(p)] * len(p)), p)]
            mine = expected.setdefault(bucket, [0.0] * len(p))
            for k in range(len(p)):
                mine[k] += n * x[k] / sum(x)
        weights = {b: [(x + 1) / (sum(e) + len(e)) for x in e] for b, e in expected.items()}
    total, out = size(whole), []
    for i, text in rows:
        s = ["<s>", "<s>", *tokens(text)]
        score = 0.0
        for gram in zip(s, s[1:], s[2:]):
            bucket, p = estimates(whole, total, *gram)
            score += math.log10(sum(a * b for a, b in zip(weights.get(bucket, [1 / len(p)] * len(p)), p)))
        base = sum(math.log10((whole[0][w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in s[2:])
        out.append((i, cls(i) == 0, len(s) - 2, sum(whole[0][w] > 0 for w in s[2:]), total, base, score))
    return out


def alike(found, wanted):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2:])
    found, wanted = sorted(map(tuple, found), key=key), sorted(wanted, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in wanted], rtol=0, atol=1e-6) if wanted else not found


def corpus(n=250, seed=4):
    rng = random.Random(seed)
    words = ["Straße", "ÉTÉ", "日本", "a b", "x", *(f"w{k}" for k in range(60))]
    return [(k, rng.choice([" ", "\n", " \t "]).join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randint(0, 60)))) for k in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_agrees_with_a_plain_model_in_many_blocks_and_buckets(spark):
    rows = corpus() + [(None, "a null id"), (None, None), (7, None), (7, ""), (9000, "  \n "), (9001, "long w1 " * 40_000), (9002, "Same same"), (9002, "Same same")]
    df = table(spark, rows).selectExpr("*", "1 as n", "'x' as block", "3 as cls", "4 as score")
    alike(lm.score(df, block_bytes=3_000, bucket_tokens=900).collect(), plain(rows))
    alike(lm.score(df).collect(), plain(rows))


def test_nothing_to_learn_from(spark):
    test_ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(k, "some words") for k in test_ids]
    found = lm.score(table(spark, rows)).collect()
    assert [tuple(r)[1:] for r in found] == [(True, 3, 0, 0, 0.0, 0.0)] * len(rows)
    assert lm.score(table(spark, [])).collect() == []


def test_weights_are_learned_where_higher_orders_tell_more(spark):
    counted = lm.Counted(table(spark, [(k, "one two three four five six") for k in range(300)]))
    weights = counted.fit().weights
    assert np.allclose(weights.sum(1), 1) and (weights >= 0).all()
    seen = weights[lm.PAIR_SEEN + 7]  # pairs that are seen some 200 times
    assert seen[3] + seen[2] > 0.95


def test_two_grams_with_one_hash_are_told_apart(spark, monkeypatch):
    rows = [{"n": 2, "bucket": 0, "block": b, "cls": lm.KEPT, "keys": lm.pack(np.array([1, 1]), np.array([5, 6])), "times": lm.pack(np.array([2, 3]))} for b in (1, 2)]
    import pyarrow as pa

    monkeypatch.setattr(lm, "_gram_hashes", lambda columns: np.zeros(len(columns[0]), np.uint64))
    out = lm._answers_grams(pa.Table.from_pylist(rows)).to_pylist()
    assert [lm.unpack(r["counts"])[0].tolist() for r in out] == [[4, 6], [4, 6]]


def test_held_out_texts_are_likelier_than_by_words_alone(spark, sf):
    rows = lm.score(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.8 * sum(r["base_score"] for r in rows)
