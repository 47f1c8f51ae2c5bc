"""Hard negatives by trees beside all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import negatives


def plain(rows, positives=5, n=5, percent=80, every=10):
    """rows: (id, label, vector)."""
    rows = [r for r in rows if None not in r and None not in r[2]]
    out = []
    for k, (a, label, v) in enumerate(rows):
        if a % every:
            continue
        found = sorted(((sum(x * y for x, y in zip(v, w)), i, other) for j, (i, other, w) in enumerate(rows) if j != k and len(w) == len(v)), key=lambda x: (-x[0], x[1]))
        for score, i, _ in [x for x in found if x[2] == label][:positives]:
            fit = [x for x in found if x[2] != label and percent * score <= 100 * x[0] <= 100 * score][:n]
            out += [(a, i, rank, b, score, s) for rank, (s, b, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id long, label int, v array<long>").selectExpr("*", "1 as row", "2 as key", "'x' as cell", "3 as score", "4 as vector", "5 as anchor")
    return sorted(tuple(r) for r in negatives.mine(df, "id", "v", "label", F.col("id") % 10 == 0, **kw).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(n, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-60, 60, (12, dim))
    return [(k, int(rng.integers(0, 4)), (centres[rng.integers(0, 12)] + rng.integers(-9, 9, dim)).tolist()) for k in range(n)]


def test_agrees_with_all_products_and_odd_rows(spark):
    same = [(k, k % 3, [50] * 8) for k in range(1000, 1300)]  # one vector a third of the time
    odd = [(2000, None, [1] * 8), (2010, 1, None), (2020, 1, [None] * 8), (None, 1, [1] * 8), (2030, 1, [4, 4]), (2031, 1, [4, 5]), (2032, 2, [4, 5]), (2040, 1, []), (2041, 1, []), (2042, 0, []), (2050, 3, [0] * 8), (2060, 7, [9] * 8)]
    twice = [(0, 1, [7] * 8)] * 2 + [(3, 2, [7] * 8)] * 2
    rows = clustered(700) + same + odd + twice
    assert mined(spark, rows) == plain(rows)


def test_many_cells_trees_blocks_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 8)
    rows = clustered(900, 6, 5)
    wanted = plain(rows)
    assert mined(spark, rows, block_bytes=8 * 6 * 20, sample=900) == wanted
    few = rows[:3]
    assert mined(spark, few) == plain(few)
    assert mined(spark, []) == []


def test_long_products_are_exact_and_too_long_ones_are_refused(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k % 2, [int(x) for x in rng.integers(2**27, 2**28, 4)]) for k in range(60)]
    assert mined(spark, rows) == plain(rows)
    with pytest.raises(ValueError, match="62 bits"):
        mined(spark, [(0, 1, [2**40] * 3)])


def test_leaves_beyond_the_annulus_are_not_compared():
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.integers(-5, 5, (600, 4)) + c for c in (np.array([90, 0, 0, 0]), np.array([0, 90, 0, 0]), np.array([0, 0, 90, 0]))])
    longest = int((vectors**2).sum(1).max())
    asked = negatives.Asked(np.array([0]), np.array([-1]), np.array([0]), np.array([[90, 0, 0, 0]]), np.array([negatives.NONE]), np.array([negatives.ALL]), True, 3)
    found, compared = negatives.Nearest(asked, longest), []
    compare = found._compare
    found._compare = lambda searches, row, *rest: (compared.append(len(row)), compare(searches, row, *rest))
    found.add(np.arange(1800), np.arange(1800), np.zeros(1800, int), vectors)
    products = vectors @ asked.vectors[0]
    assert found.id[0].tolist() == sorted(range(1800), key=lambda k: (-products[k], k))[:3]
    assert sum(compared) < 1000
