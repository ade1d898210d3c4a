import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import negatives, vectors
from tools.compare import compare, connect

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, every, scale=256, k=5, n=3):
    """All products, in Python's whole numbers."""
    known = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, [math.floor(scale * float(np.float32(x))) for x in v])
        known[i] = min(known.get(i, own), own)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in known.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, m == label) for i, (m, w) in known.items() if i != a)
        for p, i in [(-s, i) for s, i, same in scored if same][:k]:
            near = [(-s, j) for s, j, same in scored if not same and 50 * p <= -100 * s <= 95 * p][:n]
            out += [(a, i, r + 1, j, p, s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def found(spark, rows, every, scale=256):
    df = spark.createDataFrame(rows, KIND)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, scale).collect())


def clustered(n, width, seed, labels=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(labels, width))
    out = []
    for i in range(n):
        v = centers[i % labels] * rng.uniform(0, 1) + rng.normal(size=width) * 0.4
        out.append((i, (v / np.linalg.norm(v)).astype(float).tolist(), int(i % labels)))
    return out


@pytest.mark.parametrize("width, block", [(3, 1024), (16, 40), (40, 25)])
def test_equals_brute_force(spark, monkeypatch, width, block):
    monkeypatch.setattr(vectors, "LEAST", block)
    monkeypatch.setattr(vectors, "SPREAD", 1)
    rows = clustered(300, width, width)
    assert found(spark, rows, 10) == brute(rows, 10)


def test_ties_and_copies(spark):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(30)] + [(30 + i, [0.7, 0.25], i % 3) for i in range(30)]
    assert found(spark, rows, 5) == brute(rows, 5) != []


def test_scores_of_zero_and_below(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 1), (3, [0.0, -1.0], 2), (4, [-0.6, 0.0], 2)]
    assert found(spark, rows, 10) == brute(rows, 10) == [(0, 1, 1, 3, 0, 0)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.5, 0.5], 2), (3, [nan, 1.0], 2), (4, [inf, 1.0], 2), (5, None, 2),
            (6, [None, 1.0], 2), (7, [0.6, 0.6], None), (None, [0.7, 0.7], 2), (2, [0.5, 0.5], 2), (8, [], 2), (9, [1.0], 2)]
    assert found(spark, rows, 10) == brute(rows, 10) != []
    assert found(spark, [], 10) == [] and found(spark, [(0, [], 1), (1, [], 2)], 1) == []


def test_large_vectors_are_refused(spark):
    with pytest.raises(ValueError, match="squared length"):
        found(spark, [(0, [1e6], 1)], 1)


def test_clashing_columns(spark):
    rows = clustered(60, 4, 3)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], KIND + ", vector int, block int, score int")
    assert sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 5 == 0, 256).collect()) == brute(rows, 5)


def test_scan_narrows_and_stays_exact():
    rng = np.random.default_rng(0)
    columns = np.round(rng.normal(size=(32, 500)) * 2.0 ** -np.arange(32)[:, None] * 1e6)
    looks = []

    def keep(least, most):
        looks.append(len(least))
        return negatives.among_best(3)(least, most)

    anchor = columns[:, 7].copy()
    rows, scores = negatives.scan(columns, columns.min(axis=1), columns.max(axis=1), anchor, np.arange(500), keep)
    whole = (anchor @ columns).astype(np.int64)
    assert set(np.argsort(-whole)[:3]) <= set(rows) and (scores == whole[rows]).all()
    assert looks[-1] < 50


def test_query_equals_sql(spark, small):
    text, _, same = compare(spark, connect(small), small, "op12_hard_negatives")
    assert same, text
