"""Hard negatives against brute force: trees, windows, ties and the defined cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.llm import box_tree, hard_negatives as H

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
])


@pytest.mark.parametrize("spread", [2, 300])
def test_tree_search_equals_a_scan(spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread, (700, 5))
    ids = rng.permutation(700).astype(np.int64)
    tree = box_tree.BoxTree(ids, points.astype(np.float64), leaf=8, fan=3)
    assert sorted(tree.ids.tolist()) == list(range(700))
    for query in rng.integers(-spread, spread, (40, 5)):
        scores = points @ query
        windows = [(-math.inf, math.inf), (0, int(scores.max() * 0.5)), (3, 3), (10, 5)]
        found = tree.search(query.astype(float), windows, 7, without=int(ids[0]))
        for (low, high), hits in zip(windows, found):
            fits = [(-int(s), int(i)) for s, i in zip(scores, ids) if low <= s <= high and i != ids[0]]
            assert hits == [(-s, i) for s, i in sorted(fits)[:7]]


def test_bounds_hold_and_far_boxes_stay_closed():
    points = np.concatenate([np.random.default_rng(1).normal(size=(400, 3)) + 50, np.random.default_rng(2).normal(size=(400, 3)) - 50])
    tree = box_tree.BoxTree(np.arange(800), points, leaf=16, fan=4)
    query = np.array([1.0, 1.0, 1.0])
    for level in range(len(tree.lows)):
        low, high = tree.bounds(query, level, 0, len(tree.lows[level]))
        size = 16 * 4**level
        for box in range(len(low)):
            scores = tree.points[box * size : (box + 1) * size] @ query
            assert low[box] <= scores.min() + 1e-9 and scores.max() <= high[box] + 1e-9

    opened = []
    whole = tree.points
    tree.points = type("Watched", (), {"__len__": lambda self: len(whole), "__getitem__": lambda self, part: opened.append(part) or whole[part]})()
    tree.search(query, [(-math.inf, math.inf)], 5)
    assert len(opened) < 25


def brute(rows, positives=5, negatives=5):
    points = set()
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        points.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(float(np.float32(x)) * 256) for x in vector)))
    out = []
    for a in sorted(points):
        if a[0] % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], p[2])), p[0], p[1]) for p in points if p[0] != a[0] and len(p[2]) == len(a[2])]
        near = sorted(row for row in scored if row[2] == a[1])[:positives]
        for place, (s, positive, _) in enumerate(near):
            far = sorted(row for row in scored if row[2] != a[1] and 80 * -s <= 100 * -row[0] <= 100 * -s)[:negatives]
            out += [(a[0], positive, rank, n, -s, -t) for rank, (t, n, _) in enumerate(far, 1)]
    return sorted(out)


def mined(spark, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({name: F.lit("x") for name in extra})
    return sorted(tuple(row) for row in H.mined_embeddings(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_against_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(H, "LEAST", 64)
    pick = random.Random(6)
    rows = []
    for vec_id in range(700):
        vector = [pick.choice([-0.5, 0.0, 0.25, 0.5, 0.2]) for _ in range(4)]
        rows.append((vec_id, vector, 3 if pick.random() < 0.4 else pick.randrange(10)))
    rows += rows[:50]
    rows += [(vec_id, [0.5, 0.5, 0.5, 0.5], 3) for vec_id in range(1000, 1300)]  # one very common vector
    rows += [(100, [0.5, 0.25, 0.0, 0.0], 3), (200, [0.25, 0.25], 2), (201, [0.5, 0.25], 2), (202, [0.5, 0.2], 4), (300, [], 1), (301, [], 1), (302, [], 5)]
    rows += [(None, [0.5] * 4, 1), (400, None, 1), (500, [0.5] * 4, None), (600, [0.5, None, 0.5, 0.5], 1), (601, [float("nan")] * 4, 1), (602, [float("inf")] * 4, 1)]
    found = mined(spark, rows, ("id", "tile", "kind", "mark", "score"))
    assert found and found == brute(rows)


def test_large_numbers_stay_exact(spark, documents):
    rows = [(0, [3_000_000.0, 1.0], 1), (1, [3_000_000.0, 2.0], 2), (2, [2_500_000.0, 77.0], 3), (3, [2_999_999.75, 1.0], 3)]
    assert mined(spark, rows) == brute(rows) != []


def test_empty_tables(spark, documents):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1), (2, [0.5], 1)]) == []
