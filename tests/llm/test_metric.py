import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import metric, vectors
from tools.compare import compare, connect

KIND = "vec_id long, embedding array<float>"


def brute(rows, every, scale=64, k=20):
    known = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = [math.floor(scale * float(np.float32(x))) for x in v]
        known[i] = min(known.get(i, own), own)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q, v in known.items():
        if q % every == 0:
            near = sorted((-dot(v, w), i) for i, w in known.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def found(spark, rows, every, scale=64, k=20):
    df = spark.createDataFrame(rows, KIND)
    return sorted(tuple(r) for r in metric.top_k(df, F.col("vec_id") % every == 0, scale, k).collect())


def points(n, width, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, width))
    own = centers[rng.integers(8, size=n)] + spread * rng.normal(size=(n, width))
    return [(i, v.tolist()) for i, v in enumerate(own.astype(float))]


@pytest.mark.parametrize("width, block, k", [(2, 1024, 20), (8, 60, 5), (32, 40, 20), (3, 200, 1)])
def test_equals_brute_force(spark, monkeypatch, width, block, k):
    monkeypatch.setattr(vectors, "LEAST", block)
    monkeypatch.setattr(vectors, "SPREAD", 1)
    monkeypatch.setattr(metric, "PAGE", 8)
    rows = points(400, width, width)
    assert found(spark, rows, 10, k=k) == brute(rows, 10, k=k)


def test_copies_do_not_meet_in_one_tree(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST", 30)
    monkeypatch.setattr(vectors, "SPREAD", 1)
    monkeypatch.setattr(metric, "PAGE", 4)
    monkeypatch.setattr(metric, "QUERIES", 5)
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(200)] + [(200 + i, v) for i, v in points(100, 3, 1)]
    known, extent = vectors.whole(spark.createDataFrame(rows, KIND), 64, "vec_id", "embedding")
    sizes = metric.plant(known, extent).groupBy("home", "part").agg(F.sum(F.size("ids")).alias("n")).collect()
    assert max(r.n for r in sizes) <= 90 and sum(r.n for r in sizes) == 300
    assert found(spark, rows, 20) == brute(rows, 20)


def test_fewer_rows_than_asked(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (3, [-1.0, -1.0])]
    assert found(spark, rows, 20) == brute(rows, 20)
    assert found(spark, rows[:1], 20) == []
    assert found(spark, [], 20) == []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [nan, 1.0]), (2, [-inf, 1.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, []), (6, [2.0]),
            (7, [0.0, 0.0]), (7, [0.0, 0.0]), (8, [3.0, 1.0]), (8, [-3.0, 1.0]), (20, [1.0, 0.0])]
    assert found(spark, rows, 20) == brute(rows, 20)
    assert found(spark, [(0, []), (1, [])], 1) == [(0, 1, 1, 0), (1, 1, 0, 0)]


def test_clashing_columns(spark):
    rows = points(80, 4, 2)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], KIND + ", home int, vector int, score int")
    assert sorted(tuple(r) for r in metric.top_k(df, F.col("vec_id") % 10 == 0, 64).collect()) == brute(rows, 10)


def test_bounds_spare_distances():
    rng = np.random.default_rng(3)
    own = np.floor(64 * (rng.normal(size=(40, 6))[rng.integers(40, size=3000)] + 0.01 * rng.normal(size=(3000, 6))))
    square = int((own * own).sum(axis=1).max())
    pages = list(metric.grow(own, own[0], square))
    names = [f.split()[0] for f in metric.PAGES.split(", ")][2:]
    columns = list(zip(*((p, q, c.astype(np.int32), r, t, rows, own[rows].astype(np.int32).ravel(), d) for p, q, c, r, t, rows, d in pages)))
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64())]
    tree = metric.Tree(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names), 6, square)
    seen, leaf = [], tree._leaf
    tree._leaf = lambda p, *rest: (seen.append(p), leaf(p, *rest))
    (_, ids, scores), = tree.search(np.array([-1]), own[:1], np.array([metric.NONE]), 10)
    whole = (own @ own[0]).astype(np.int64)
    assert scores.tolist() == sorted(whole, reverse=True)[:10] and (whole[ids] == scores).all()
    leaves = sum(len(rows) > 0 for *_, rows, _ in pages)
    assert sum(len(rows) for *_, rows, _ in pages) == 3000 and len(seen) < leaves


def test_query_equals_sql(spark, small):
    text, _, same = compare(spark, connect(small), small, "op13_exact_top_k")
    assert same, text
