"""Hard negatives by vertical scans with branch-and-bound over dimensions (BOND).

Vectors are stored in blocks, a column per dimension with its least and greatest
value. An anchor reads a block's dimensions in descending order of its own
components' size and sums products. What the dimensions not yet read can still add
lies between two sums over their least and greatest values, so every candidate's
score has a lower and an upper bound. Candidates that can no longer matter leave the
bitmap, and the columns left are narrowed once it has halved. Scores of those that
stay are exact in the end.

A first scan finds each anchor's positives, which give score windows; a second scan
finds the best rows of other labels inside each window. Every anchor meets every
block: anchors are dealt into parts and go to the blocks, a block and a part a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import written
from folioscope.llm.vectors import Extent, matrix, whole
from folioscope.operators.ordering import first_k

POSITIVES, NEGATIVES = 5, 3
#: A negative's score against its positive's, in percent.
LOW, HIGH = 50, 95
#: The bitmap is looked at when what is left to add has fallen to these shares.
LOOKS = (0.6, 0.4, 0.27, 0.18, 0.12, 0.08, 0.04)

COLUMNS = "block bigint, ids array<bigint>, labels array<bigint>, columns array<int>, lows array<int>, highs array<int>"


def columnar(rows: DataFrame, extent: Extent) -> DataFrame:
    """One row per block: ids in ascending order, labels, and the components
    dimension by dimension with the extremes of each."""

    def run(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("vec_id")
        across = matrix(own.column("vector"), extent.width).astype(np.int32).T
        lists = {
            "ids": own.column("vec_id").to_pylist(), "labels": own.column("label").to_pylist(),
            "columns": across.ravel(), "lows": across.min(axis=1), "highs": across.max(axis=1),
        }
        kinds = {k: pa.list_(pa.int64() if k in ("ids", "labels") else pa.int32()) for k in lists}
        return pa.table({"block": [key[0].as_py()]} | {k: pa.array([v], kinds[k]) for k, v in lists.items()})

    block = F.pmod(F.xxhash64("vec_id"), F.lit(extent.blocks))
    return written(rows.withColumn("block", block).groupBy("block").applyInArrow(run, COLUMNS), "columns")


def scan(columns: np.ndarray, lows: np.ndarray, highs: np.ndarray, anchor: np.ndarray, rows: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that ``keep(least, most)`` leaves, and their exact scores."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    a = anchor[order]
    ends = np.stack([a * lows[order], a * highs[order]])
    least, most = (np.append(np.cumsum(x[::-1])[::-1], 0.0) for x in (ends.min(axis=0), ends.max(axis=0)))
    span = most - least
    stops = sorted({int(np.argmax(span <= share * span[0])) for share in LOOKS} | {len(a)})
    rest = columns[order] if len(rows) == columns.shape[1] else columns[order][:, rows]
    sums, at, base = np.zeros(len(rows)), 0, 0
    alive = np.ones(len(rows), bool)
    for stop in stops:
        sums += a[at:stop] @ rest[at - base : stop - base]
        at = stop
        alive[alive] = keep(sums[alive] + least[at], sums[alive] + most[at])
        left = int(np.count_nonzero(alive))
        if not left:
            break
        if 2 * left <= len(rows) and at < len(a):
            rest, base = rest[at - base :][:, alive], at
            rows, sums, alive = rows[alive], sums[alive], alive[alive]
    return rows[alive], sums[alive].astype(np.int64)


def among_best(k: int, floor: float = -np.inf, ceiling: float = np.inf) -> Callable:
    """Keeps what may be one of the ``k`` highest scores from floor to ceiling:
    once ``k`` rows are surely inside, others must be able to reach the least of them."""

    def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        sure = least[(least >= floor) & (most <= ceiling)]
        bar = np.partition(sure, -k)[-k] if len(sure) >= k else floor
        return (most >= bar) & (least <= ceiling)

    return keep


def _meet(anchors: DataFrame, blocks: DataFrame, extent: Extent, run: Callable, schema: str) -> DataFrame:
    """``run(block, anchors)`` for each block and each part of the anchors."""
    parts = max(1, -(-anchors.count() // extent.block))
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name)
    asking = anchors.select("*", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).alias("part"), each(extent.blocks, "block"))
    asked = blocks.select("*", each(parts, "part"))
    return asked.groupBy("block", "part").cogroup(asking.groupBy("block", "part")).applyInArrow(run, schema)


class Block:
    def __init__(self, row: pa.Table, width: int) -> None:
        get = lambda name: row.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.ids, self.labels = get("ids"), get("labels")
        self.columns = get("columns").astype(np.float64).reshape(width, len(self.ids))
        self.lows, self.highs = get("lows").astype(np.float64), get("highs").astype(np.float64)

    def scan(self, anchor: np.ndarray, rows: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
        return scan(self.columns, self.lows, self.highs, anchor, rows, keep)


def positives(anchors: DataFrame, blocks: DataFrame, extent: Extent, k: int = POSITIVES) -> DataFrame:
    """``anchor_id, positive_id, score``: the first ``k`` other rows of the
    anchor's label, by descending score and ascending id."""

    def run(own: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if own.num_rows and asking.num_rows:
            block = Block(own, extent.width)
            vectors = matrix(asking.column("vector"), extent.width)
            of_label = {x: np.flatnonzero(block.labels == x) for x in np.unique(block.labels).tolist()}
            for name, label, anchor in zip(asking.column("anchor_id").to_pylist(), asking.column("label").to_pylist(), vectors):
                rows = of_label.get(label, np.empty(0, np.int64))
                rows, scores = block.scan(anchor, rows[block.ids[rows] != name], among_best(k))
                first = np.argsort(-scores, kind="stable")[:k]
                found += zip([name] * len(first), block.ids[rows[first]].tolist(), scores[first].tolist())
        return _table(found, ["anchor_id", "positive_id", "score"])

    local = _meet(anchors, blocks, extent, run, "anchor_id bigint, positive_id bigint, score bigint")
    return first_k(local, ["anchor_id"], [F.col("score").desc(), "positive_id"], k).drop("position")


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    across = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, across)})


def _negatives(anchors: DataFrame, blocks: DataFrame, extent: Extent, k: int, low: int, high: int) -> DataFrame:
    """The ``k`` best rows of other labels in each window of ``anchors``, which
    hold the positives as a list."""

    def run(own: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if own.num_rows and asking.num_rows:
            block = Block(own, extent.width)
            vectors = matrix(asking.column("vector"), extent.width)
            of_others = {x: np.flatnonzero(block.labels != x) for x in np.unique(block.labels).tolist()}
            every = np.arange(len(block.ids))
            wanted = zip(asking.column("anchor_id").to_pylist(), asking.column("label").to_pylist(), asking.column("positives").to_pylist(), vectors)
            for name, label, near, anchor in wanted:
                windows = [(-(-low * p["score"] // 100), high * p["score"] // 100, p) for p in near]
                windows = [w for w in windows if w[0] <= w[1]]
                keeps = [among_best(k, bottom, top) for bottom, top, _ in windows]
                if not windows:
                    continue
                keep = lambda least, most: np.logical_or.reduce([f(least, most) for f in keeps])
                rows, scores = block.scan(anchor, of_others.get(label, every), keep)
                order = np.argsort(-scores, kind="stable")
                rows, scores = rows[order], scores[order]
                for bottom, top, p in windows:
                    first = np.flatnonzero((scores >= bottom) & (scores <= top))[:k]
                    for i in first:
                        found.append((name, p["positive_id"], int(block.ids[rows[i]]), p["score"], int(scores[i])))
        return _table(found, NEGATIVE)

    return _meet(anchors, blocks, extent, run, ", ".join(f"{n} bigint" for n in NEGATIVE))


NEGATIVE = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]


def mine(
    rows: DataFrame, anchors: Column, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows that meet the condition ``anchors`` (over ``vec_id``,
    ``label``, ``vector``). Scores are products of whole-number vectors, see
    ``vectors.whole`` for which rows take part; order is by descending score, then
    ascending id. A negative has another label and ``low`` to ``high`` percent of the
    positive's score, both included: a positive with a score below 0 has none, one
    of score 0 those of score 0. Anchors without positives and positives without
    negatives give no rows; an empty table gives none."""
    known, extent = whole(rows, scale, id_col, vector_col, label_col)
    blocks = columnar(known, extent)
    asking = known.where(anchors).select(F.col("vec_id").alias("anchor_id"), "label", "vector")
    near = written(positives(asking, blocks, extent, n_positives), "positives")
    listed = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))
    found = _negatives(asking.join(listed, "anchor_id"), blocks, extent, n_negatives, low, high)
    best = first_k(found, ["anchor_id", "positive_id"], [F.col("negative_score").desc(), "negative_id"], n_negatives, "rank")
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
