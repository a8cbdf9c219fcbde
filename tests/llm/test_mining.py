"""Hard negatives against every pair's score."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import mining

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, shard string, dim string, pieces string"


def _brute(rows, every=10, positives=5, negatives=3):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v], g) for i, v, g, *_ in rows if i is not None and g is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, (i, x, g) in enumerate(kept):
        if i % every:
            continue
        score = [(sum(p * q for p, q in zip(x, y, strict=True)), j, h, b) for b, (j, y, h) in enumerate(kept) if b != a and len(y) == len(x)]
        for s, j, *_ in sorted((r for r in score if r[2] == g), key=lambda r: (-r[0], r[1], r[3]))[:positives]:
            window = sorted((r for r in score if r[2] != g and 50 * s <= 100 * r[0] <= 95 * s), key=lambda r: (-r[0], r[1], r[3]))[:negatives]
            out += [(i, j, n, r[1], s, r[0]) for n, r in enumerate(window, 1)]
    return sorted(out)


def _rows(n=600, dim=10, labels=6):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((labels, dim))
    of = np.where(rng.random(n) < 0.4, 0, rng.integers(0, labels, n))  # a label with two fifths of the rows
    x = centres[of] + rng.standard_normal((n, dim))
    x[100:150] = x[100]
    x[7] = 0
    return [(i, [float(c) for c in np.float32(v)], int(g), "clash", "", "", "") for i, (v, g) in enumerate(zip(x, of, strict=True))]


def _mined(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mining.mine(mining.clean(frame), F.col("vec_id") % 10 == 0, **more).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


@pytest.mark.parametrize("shard_rows", [60, 10_000])
def test_equals_all_pairs(spark, shard_rows):
    rows = _rows()
    assert _mined(spark, rows, shard_rows=shard_rows, block_rows=20) == _brute(rows)


def test_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5], 0), (10, [0.0, 0.0], 0), (1, [1.0, 0.5], 0), (1, [1.0, 0.5], 0), (2, [0.75, 0.25], 1), (2, [0.75, 0.25], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [None, 1.0], 1), (6, [0.5, 0.5], None), (None, [0.5, 0.5], 1), (8, [0.5], 1), (9, [], 1), (20, [-1.0, 0.0], 2)]
    rows = [(*r, "", "", "", "") for r in rows]
    got = _mined(spark, rows)
    assert got == _brute(rows) and (0, 1, 1, 2, 320 * 256, 224 * 256) in got
    assert _mined(spark, rows[:0]) == []


def test_lists_stop_where_the_threshold_says():
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((5000, 3)) * 256)
    lists = mining.Lists(np.arange(5000), np.arange(5000), np.array(["a", "b"] * 2500, object), x)
    for q in x[:40]:
        lists.scored = 0
        score = x @ q
        high = float(score.max() * 0.9)
        odd = lists.labels == "b"
        (top, s), (inner, _) = lists.best(q, odd, [(-np.inf, np.inf), (high / 2, high)], 3)
        order = np.lexsort((np.arange(5000), -score))
        assert top.tolist() == [i for i in order if odd[i]][:3] and s.tolist() == score[top].tolist()
        assert inner.tolist() == [i for i in order if odd[i] and high / 2 <= score[i] <= high][:3]
        assert lists.scored < 0.6 * 5000


@pytest.mark.parametrize("size", [1.0, 2.0**30, 2.0**50])
def test_scores_are_exact_at_any_size(size):
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 51, (300, 4)) * size + rng.integers(0, 2, (300, 4))
    lists = mining.Lists(np.arange(300), np.arange(300), np.zeros(300, object), x)
    whole = [[int(c) for c in r] for r in x]
    for i in range(20):
        at, s = lists.best(x[i], np.arange(300) != i, [(-np.inf, np.inf)], 4)[0]
        want = sorted((-sum(a * b for a, b in zip(whole[i], y, strict=True)), j) for j, y in enumerate(whole) if j != i)[:4]
        assert [(-int(v), int(j)) for j, v in zip(at, s, strict=True)] == want
