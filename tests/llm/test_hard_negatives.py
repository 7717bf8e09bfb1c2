"""Hard negatives against brute force: shards, windows, ties, odd rows, wide numbers; and that searches stop early."""

import math

import numpy as np
import pytest

from tidewater.llm import hard_negatives as hn

ROWS = "vec_id long, embedding array<float>, label int, rank int, q string"


def mined(rows, anchors, positives=5, negatives=3, low=50, high=95, scale=256):
    usable = lambda i, v, g: i is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(scale * x) for x in v]
    kept = [(i, whole(v), g) for i, v, g in rows if usable(i, v, g)]
    asked = {}
    for i, v, g in anchors:
        if usable(i, v, g):
            asked[i] = min(asked.get(i, (str(g), whole(v))), (str(g), whole(v)))
    out = []
    for a, (g, v) in asked.items():
        scored = sorted((-max(-hn.MOST, min(hn.MOST, sum(x * y for x, y in zip(v, w, strict=True)))), i, str(h)) for i, w, h in kept if i != a and len(w) == len(v))
        for ps, p, _ in [x for x in scored if x[2] == g][:positives]:
            inside = [(i, -s) for s, i, h in scored if h != g and low * -ps <= 100 * -s <= high * -ps]
            out += [(a, p, k + 1, i, -ps, s) for k, (i, s) in enumerate(inside[:negatives])]
    return sorted(out)


def got(spark, rows, anchors, schema=ROWS, **options):
    make = lambda r: spark.createDataFrame([(*x, 1, "x") for x in r], schema)
    return sorted(tuple(r) for r in hn.hard_negatives(make(rows), make(anchors), **options).collect())


def vectors(n, d, seed, spread=3.0):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(0, 1 / spread, (n, d)), 2).astype(np.float32).tolist()


def test_ties_labels_and_blocks(spark):
    rng = np.random.default_rng(2)
    v = vectors(60, 6, 1)
    rows = [(i, v[rng.integers(0, 60)], int(rng.integers(0, 4))) for i in range(400)] + [(1000 + i, v[0], 1) for i in range(150)]  # a hot vector
    asked = [r for r in rows if r[0] % 20 == 0]
    assert got(spark, rows, asked, cells=300) == mined(rows, asked)
    assert got(spark, rows, asked, block=7, cells=2000, positives=2, negatives=50, low=10, high=100) == mined(rows, asked, 2, 50, 10, 100)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [1.0, 1.0], None), (7, [0.0, 0.0], 1), (8, [1.0, 0.5], 1), (8, [1.0, 0.5], 1), (9, [0.75, 0.5], 2), (10, [0.7, 0.5], 2), (11, [1.0, 1.0, 1.0], 1), (12, [1.0, 1.0, 0.8], 1), (13, [0.6, 0.6, 0.6], 3), (14, [0.9, 0.6], 1), (7, [0.5, 0.5], 2)]
    assert got(spark, rows, rows) == mined(rows, rows)
    assert got(spark, rows, []) == got(spark, [], rows) == []
    with pytest.raises(ValueError, match="whole numbers"):
        hn.hard_negatives(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<double>, label int"), spark.range(1))


def test_numbers_beyond_doubles(spark):
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(np.random.default_rng(4).integers(-(1 << 40), 1 << 40, (40, 3)).tolist())]
    schema = ROWS.replace("float", "double")
    assert got(spark, rows, rows[:6], schema, scale=1) == mined(rows, rows[:6], scale=1)
    far = [(i, [x * 2.0**20 for x in v], g) for i, v, g in rows]
    assert got(spark, far, far[:3], schema, scale=1) == mined(far, far[:3], scale=1)


def test_threshold_stops_a_search():
    """With few dimensions and a clear best row the lists are read to a small depth, and the result is the same."""
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.integers(-50, 50, (20_000, 3)), [[300, 300, -300], [290, 300, -300], [280, 300, -290]]])
    ids = np.arange(len(m))
    lists, found = hn.Lists(m, ids, False), hn.Found([-hn.MOST], [hn.MOST], 3)
    depth = lists.search(np.array([2, 1, -1]), found, lambda i: np.ones(len(i), bool))
    assert depth < len(m) // 50 and found.rows[0][1].tolist() == [20_000, 20_001, 20_002]
    tied, found = hn.Lists(np.ones((500, 2), np.int64), np.arange(500)[::-1], False), hn.Found([-hn.MOST], [hn.MOST], 3)
    assert tied.search(np.array([1, 1]), found, lambda i: np.ones(len(i), bool)) == 500 and found.rows[0][1].tolist() == [0, 1, 2]  # equal scores never stop it
