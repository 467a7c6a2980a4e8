"""R-trees and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from faultloom.llm import rtree


def brute(rows, anchors, positives=5, negatives=5, low=80, high=100):
    """All result rows from (vec_id, label, vector) with vectors filled up with zeros."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in anchors:
        scored = sorted((-dot(v, w), j, m) for j, m, w in rows)
        for minus, j, _ in [s for s in scored if s[2] == label and s[1] != i][:positives]:
            fits = [s for s in scored if s[2] != label and low * -minus <= 100 * -s[0] <= high * -minus]
            out += [(i, j, r, n, -minus, -score) for r, (score, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def floored(rows):
    out = []
    for i, label, v in rows:
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            out.append((i, label, [max(-rtree.LARGEST, min(rtree.LARGEST, math.floor(256 * np.float64(np.float32(x))))) for x in v]))
    return out


def clustered(rng, n, dims, labels=10):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels) if rng.random() < 0.7 else 3
        rows.append((i, label, [c + rng.gauss(0, 0.3) for c in centres[label]]))
    return rows


def test_search():
    rng = np.random.default_rng(1)
    for n, dims in ((1, 3), (64, 2), (700, 5), (5000, 16)):
        ids, labels, points = rng.permutation(n).astype(np.int64), rng.integers(0, 4, n), rng.integers(-50, 50, (n, dims)).astype(np.int32)
        order = rtree.pack(labels, points)
        assert sorted(order) == list(range(n))
        tree = rtree.Tree(ids[order], labels[order], points[order])
        for _ in range(10):
            q, label = rng.integers(-50, 50, dims), int(rng.integers(0, 5))
            scores = points.astype(int) @ q
            windows = [(int(a), int(a) + int(b)) for a, b in zip(rng.integers(-900, 900, 3), rng.integers(0, 2000, 3))]
            best = lambda fits: sorted((-int(scores[i]), int(ids[i])) for i in np.flatnonzero(fits))[:4]  # noqa: B023
            want = [best((labels != label) & (scores >= a) & (scores <= b)) for a, b in windows]
            assert tree.search(q, label, None, windows, 4) == [[(-s, i) for s, i in w] for w in want]
            own = int(ids[0])
            got = tree.search(q, label, own, [(-(1 << 62), 1 << 62)], 4)[0]
            assert got == [(-s, i) for s, i in best((labels == label) & (ids != own))]


def test_boxes_are_pruned():
    rng = random.Random(2)
    rows = clustered(rng, 4000, 4)
    labels, points = np.array([r[1] for r in rows]), np.array([[int(256 * x) for x in r[2]] for r in rows], dtype=np.int32)
    order = rtree.pack(labels, points)
    tree = rtree.Tree(np.arange(4000)[order], labels[order], points[order])
    looked, bounds = [], tree._bounds
    tree._bounds = lambda level, a, b, *x: looked.append(b - a if level == 0 else 0) or bounds(level, a, b, *x)
    tree.search(points[0], int(labels[0]), 0, [(-(1 << 62), 1 << 62)], 5)
    assert 0 < sum(looked) < len(tree.levels[0][0])


@pytest.mark.parametrize("parts, tree_rows", [(1, 1 << 16), (6, 64)])
def test_mined(spark, parts, tree_rows, monkeypatch):
    monkeypatch.setattr(rtree, "TASK_ROWS", 100)
    rng = random.Random(parts)
    rows = clustered(rng, 900, 8)
    rows += [(i, 3, rows[3][2]) for i in range(1000, 1400)]  # one very common vector
    rows += [(2000, 1, [1.0] * 8)] * 3 + [(2001, 2, [1.0] * 8)] * 2  # repeated rows
    rows += [(2100, 4, []), (2101, 4, [0.5]), (2102, 4, [0.1] * 11), (2200, 5, [0.0] * 8), (2201, -3, [2e9] * 8)]
    rows += [(None, 1, [1.0] * 8), (2300, None, [1.0] * 8), (2302, 1, None), (2303, 1, [None, 1.0]), (2304, 1, [float("nan")]), (2305, 1, [float("inf")])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, anchor long, tree string").repartition(parts)
    ready = floored(rows)
    vectors = rtree.integers(table).selectExpr("vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) as label", "vector")
    got = rtree.mine(vectors, vectors.where("vec_id % 100 = 0"), tree_rows=tree_rows).collect()
    want = brute(ready, [r for r in ready if r[0] % 100 == 0])
    assert sorted(map(tuple, got)) == want and len(want) > 50
    got = rtree.mine(vectors, vectors.where("vec_id % 100 = 0"), 3, 2, 33, 77, tree_rows).collect()
    assert sorted(map(tuple, got)) == brute(ready, [r for r in ready if r[0] % 100 == 0], 3, 2, 33, 77)


def test_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert rtree.report(none).collect() == []
    alone = spark.createDataFrame([(100, 1, [0.5])], none.schema)
    assert rtree.report(alone).collect() == []
