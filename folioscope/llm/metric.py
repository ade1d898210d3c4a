"""Exact top-k by inner product with best-first search in M-trees.

With h(x) = sqrt(M - |x|^2), M the greatest squared length, the points (x, h(x)) and
the query (q, 0) lie sqrt(|q|^2 + M - 2 q.x) apart: the highest products are the
nearest points of a metric space, and triangle bounds hold.

Rows of smallest hash, one per block of rows, are the routing objects of the top. A
row belongs to the nearest one; what gathers at one beyond a block's size is dealt
into several trees by hash, so copies never meet in one task. A tree is built from
its rows in one task and written page by page: a page has its routing object, covering
radius and distance to the parent's routing object, and a leaf's entries are ordered
by their distance to it.

A query first goes to the tree with the least bound, all others follow with the k-th
score found there, unless their bounds exceed it. In a tree, every query opens its
best page next, and queries that open the same page share a matrix product. A child's
distance is only computed if its stored distances leave it in reach, and of a leaf
only the entries whose distance to the routing object does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import written
from folioscope.llm.vectors import matrix, whole
from folioscope.operators.ordering import first_k

TOP = 20
#: Entries of a leaf, children of a page, queries that meet a tree at once.
PAGE, FANOUT, QUERIES = 128, 16, 4_096
#: Distances count as equal within this share of the greatest length.
SLACK = 1e-6

PAGES = "home bigint, part bigint, page int, parent int, center array<int>, radius double, to_parent double, ids array<bigint>, entries array<int>, distances array<double>"
NONE = np.iinfo(np.int64).min


def between(x: np.ndarray, y: np.ndarray, square: int) -> np.ndarray:
    """Distances of all rows of ``x`` to all of ``y``, lifted."""
    own, other = (np.einsum("ij,ij->i", v, v) for v in (x, y))
    lifted = np.sqrt(square - own)[:, None] * np.sqrt(square - other)
    return np.sqrt(np.maximum(0.0, 2.0 * (square - x @ y.T - lifted)))


def from_query(queries: np.ndarray, centers: np.ndarray, square: int) -> np.ndarray:
    own = np.einsum("ij,ij->i", queries, queries)
    return np.sqrt(np.maximum(0.0, own[:, None] + square - 2.0 * (queries @ centers.T)))


def grow(vectors: np.ndarray, center: np.ndarray, square: int) -> Iterator[tuple]:
    """Pages ``(page, parent, center, radius, to_parent, rows, distances)`` of one
    tree, parents first; ``rows`` is empty but for leaves."""
    todo, page = [(np.arange(len(vectors)), -1, center, 0.0)], 0
    while todo:
        rows, parent, center, to_parent = todo.pop()
        apart = between(vectors[rows], center[None], square)[:, 0]
        order = np.argsort(apart, kind="stable")
        rows, apart = rows[order], apart[order]
        leaf = len(rows) <= PAGE
        yield page, parent, center, float(apart[-1]), to_parent, rows if leaf else rows[:0], apart if leaf else apart[:0]
        if not leaf:
            k = min(FANOUT, -(-len(rows) // PAGE))
            seeds = rows[np.linspace(0, len(rows) - 1, k).astype(int)]
            nearest = between(vectors[rows], vectors[seeds], square).argmin(axis=1)
            sides = [rows[nearest == i] for i in range(k)]
            if max(map(len, sides)) > 0.9 * len(rows):  # nearly all alike
                sides = np.array_split(rows, k)
                seeds = [side[len(side) // 2] for side in sides]
            for side, seed in zip(sides, seeds):
                if len(side):
                    todo.append((side, page, vectors[seed], float(between(vectors[[seed]], center[None], square)[0, 0])))
        page += 1


class Tree:
    """The pages of one tree, and the search for many queries at once."""

    def __init__(self, pages: pa.Table, width: int, square: int) -> None:
        pages = pages.sort_by("page")
        self.square, self.slack = square, SLACK * max(1.0, square) ** 0.5
        self.centers = matrix(pages.column("center"), width)
        self.radius, self.to_parent = (pages.column(n).to_numpy() for n in ("radius", "to_parent"))
        parents = pages.column("parent").to_numpy()
        self.children = [np.flatnonzero(parents == i) for i in range(len(parents))]
        sizes = pages.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])
        flat = lambda name: pages.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.ids, self.distances = flat("ids"), flat("distances")
        self.entries = flat("entries").astype(np.float64).reshape(len(self.ids), width)
        by_id = np.sort(self.ids)
        self.size = len(by_id)
        self.behind = self.size - 1 - np.searchsorted(by_id, self.ids)  # larger for smaller ids
        self.by_id = by_id

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(query, ids, scores)``: up to ``k`` best entries but the query's own,
        of those with a score of at least the query's ``floor``."""
        n, own = len(queries), np.einsum("ij,ij->i", queries, queries)
        best = np.full((n, k), NONE)  # score and place by id as one number
        reach = self._reach(own, floor)
        open_, apart = (np.full((n, len(self.radius)), np.inf) for _ in range(2))
        apart[:, 0] = from_query(queries, self.centers[:1], self.square)[:, 0]
        open_[:, 0] = np.maximum(0.0, apart[:, 0] - self.radius[0])
        while True:
            page = open_.argmin(axis=1)
            bound = open_[np.arange(n), page]
            active = np.flatnonzero((bound <= reach) & (bound < np.inf))
            if not len(active):
                break
            for p in np.unique(page[active]):
                rows = active[page[active] == p]
                open_[rows, p] = np.inf
                if len(self.children[p]):
                    self._inner(p, rows, queries, open_, apart, reach)
                else:
                    self._leaf(p, rows, ids, queries, own, apart, reach, best, floor, k)
        for i in range(n):
            kept = np.sort(best[i][best[i] != NONE])[::-1]
            places = self.size - 1 - kept % self.size
            yield i, self.by_id[places], kept // self.size

    def _reach(self, own: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which entries have this score; all of it where there is none."""
        far = np.sqrt(np.maximum(0.0, own + self.square - 2.0 * score)) + self.slack
        return np.where(score == NONE, np.inf, far)

    def _inner(self, p: int, rows: np.ndarray, queries: np.ndarray, open_: np.ndarray, apart: np.ndarray, reach: np.ndarray) -> None:
        below = self.children[p]
        stored = np.abs(apart[rows, p][:, None] - self.to_parent[below]) - self.radius[below]
        near = stored <= reach[rows][:, None] + self.slack
        some = near.any(axis=0)
        below, near = below[some], near[:, some]
        if not len(below):
            return
        to = from_query(queries[rows], self.centers[below], self.square)
        at = np.ix_(rows, below)
        apart[at] = to
        open_[at] = np.where(near, np.maximum(0.0, to - self.radius[below]), np.inf)

    def _leaf(self, p, rows, ids, queries, own, apart, reach, best, floor, k) -> None:
        start, end = self.cuts[p], self.cuts[p + 1]
        here, far = apart[rows, p], reach[rows] + self.slack
        lows = np.searchsorted(self.distances[start:end], here - far)
        highs = np.searchsorted(self.distances[start:end], here + far, "right")
        some = lows < highs
        if not some.any():
            return
        rows = rows[some]
        start, end = start + lows[some].min(), start + highs[some].max()
        scores = (queries[rows] @ self.entries[start:end].T).astype(np.int64)
        marks = scores * self.size + self.behind[start:end]
        marks[(scores < floor[rows][:, None]) | (self.ids[start:end] == ids[rows][:, None])] = NONE
        both = np.concatenate([best[rows], marks], axis=1)
        best[rows] = np.partition(both, -k, axis=1)[:, -k:]
        least = best[rows].min(axis=1)
        full = least != NONE
        bar = np.maximum(floor[rows], np.where(full, least // self.size, NONE))
        reach[rows] = np.minimum(reach[rows], self._reach(own[rows], bar))


def plant(known: DataFrame, extent) -> DataFrame:
    """The pages of all trees over ``vec_id, vector``, written."""
    square, width = extent.square, extent.width
    chosen = known.orderBy(F.xxhash64("vec_id"), "vec_id").limit(extent.blocks).select("vector").toArrow()
    centers = matrix(chosen.column(0), width)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nearest = between(matrix(b.column(1), width), centers, square).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest.astype(np.int64))], ["vec_id", "vector", "home"])

    def build(key: tuple, own: pa.Table) -> pa.Table:
        home, part = (x.as_py() for x in key)
        vectors, ids = matrix(own.column("vector"), width), own.column("vec_id").to_numpy()
        out = [
            (home, part, page, parent, center.astype(np.int32), radius, to_parent, ids[rows], vectors[rows].astype(np.int32).ravel(), distances)
            for page, parent, center, radius, to_parent, rows, distances in grow(vectors, centers[home], square)
        ]
        ints, longs, doubles = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64())
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), ints, pa.float64(), pa.float64(), longs, ints, doubles]
        names = [f.split()[0] for f in PAGES.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    housed = written(known.select("vec_id", "vector").mapInArrow(home, "vec_id bigint, vector array<int>, home bigint"), "housed")
    crowds = housed.groupBy("home").agg(F.ceil(F.count("*") / extent.block).alias("parts"))
    dealt = housed.join(crowds, "home").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return written(dealt.select("home", "part", "vec_id", "vector").groupBy("home", "part").applyInArrow(build, PAGES), "pages")


def _routes(queries: DataFrame, roots: pa.Table, extent, k: int, first: bool) -> DataFrame:
    """``query_id, vector, floor, home, part``: for each query its best tree, or
    else all others whose bound its floor does not rule out."""
    centers, radius = matrix(roots.column("center"), extent.width), roots.column("radius").to_numpy()
    names = [roots.column(n).to_numpy() for n in ("home", "part")]
    square, slack = extent.square, SLACK * max(1.0, extent.square) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = matrix(b.column(1), extent.width)
            bounds = np.maximum(0.0, from_query(own, centers, square) - radius)
            best = bounds.argmin(axis=1)
            if first:
                rows, trees = np.arange(len(own)), best
            else:
                floor = b.column(2).to_numpy()
                far = np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", own, own) + square - 2.0 * floor)) + slack
                near = bounds <= np.where(floor == NONE, np.inf, far)[:, None]
                near[np.arange(len(own)), best] = False
                rows, trees = np.nonzero(near)
            asked = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*asked.columns, *(pa.array(x[trees]) for x in names)], [*b.schema.names, "home", "part"])

    return queries.mapInArrow(run, "query_id bigint, vector array<int>, floor bigint, home bigint, part bigint")


def _visit(routes: DataFrame, pages: DataFrame, extent, k: int) -> DataFrame:
    """What the queries find in the trees they go to. A tree with many visits is
    searched in several tasks, each with a share of the queries."""
    crowds = routes.groupBy("home", "part").agg(F.ceil(F.count("*") / QUERIES).alias("chunks"))
    asked = routes.join(crowds, ["home", "part"]).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks"))).drop("chunks")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk")
    sent = pages.join(crowds, ["home", "part"]).select(*pages.columns, each)

    def run(own: pa.Table, asking: pa.Table) -> pa.Table:
        ids, found, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if own.num_rows and asking.num_rows:
            names = asking.column("query_id").to_numpy()
            tree = Tree(own, extent.width, extent.square)
            for i, near, score in tree.search(names, matrix(asking.column("vector"), extent.width), asking.column("floor").to_numpy(), k):
                ids.append(np.full(len(near), names[i]))
                found.append(near)
                scores.append(score)
        return pa.table({"query_id": np.concatenate(ids), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    keys = ["home", "part", "chunk"]
    return sent.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(rows: DataFrame, queries: Column, scale: int, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that meets the condition
    ``queries`` (over ``vec_id``, ``vector``) the ``k`` other rows of highest
    product of whole-number vectors, ties by ascending id.

    See ``vectors.whole`` for which rows take part. Equal vectors under different
    ids are rows of their own. A table without other rows gives no rows."""
    known, extent = whole(rows, scale, id_col, vector_col)
    pages = plant(known, extent)
    # one row per tree, about a block's share of the rows
    roots = pages.where("page = 0").select("home", "part", "center", "radius").orderBy("home", "part").toArrow()
    asking = known.where(queries).select(F.col("vec_id").alias("query_id"), "vector", F.lit(NONE).cast("bigint").alias("floor"))
    if not roots.num_rows:
        return asking.select("query_id", F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    first = written(_visit(written(_routes(asking, roots, extent, k, True), "routes"), pages, extent, k), "first")
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("found"))
    rest = asking.join(floors, "query_id", "left").select("query_id", "vector", F.coalesce("found", "floor").alias("floor"))
    second = _visit(written(_routes(rest, roots, extent, k, False), "routes"), pages, extent, k)
    best = first_k(first.unionByName(second), ["query_id"], [F.col("score").desc(), "vec_id"], k, "rank")
    return best.select("query_id", "rank", "vec_id", "score")
