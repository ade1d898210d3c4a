"""SimHash near-duplicates found with vantage-point trees.

A text becomes a 64-bit fingerprint of its word shingles. Equal fingerprints
are folded first, so a group of copies of any size is one point. The points are
cut into shards by a vantage-point tree: a node has a vantage point and a
distance, nearer points go left, others right. Two points within ``radius`` may
still fall on both sides; by the triangle inequality the right one is then at
most ``radius`` beyond the node's distance, so such points visit the left side
as well, as queries. Each shard runs the same split in memory until blocks are
small, compares exactly and returns only a spanning forest of its links. The
forests of all shards are joined to components by rounds of min-label stars.

Copies with a similarity of 0.8 lie some ten bits apart, where triangle bounds in
64 bits prune nothing. ``similar_links`` finds those another way. First texts meet
by fingerprints of a few of their shingles, each meets the first and the last of
such a group, and a pair counts if the shingle sets really are that similar. Then
what that left apart is compared exactly: of two such sets each has one of the
other's shingles among the first fifth of its own in any common order, so texts of
different groups that share one there are candidates: pair by pair, bounded by size,
place and the number of shingles shared, or block by block where many share one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import batches_of, discard, fresh_path, written

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Points that the top of the tree is built from (those of smallest hash), and
#: the points a shard should have.
SAMPLE, SHARD = 32_768, 4_096
#: Pairs that are compared at once without splitting further.
BLOCK = 1 << 20
#: Shingles whose bits are counted at once, and texts that a worker gets at once.
PIECE, TEXTS = 1 << 14, 1_024

#: Similarity of word shingle sets, in words, above which texts are near copies;
#: keys of a text, and shingles that make a key.
SIMILARITY, WORDS = 0.8, 5
KEYS, PICKED = 24, 3
#: Texts whose shingles show which ones are common, the texts of those that one is
#: in, and how many are put last in the order. They choose an order only.
LOOKED, OFTEN, LAST = 8_192, 4, 65_536
#: Texts outside its largest group that share a first shingle, above which all that
#: share it are compared in blocks, shingles of a block, sets of a block whose
#: pairs are counted at once, and pairs of blocks that a task compares.
HOT, HELD, TILE, CELLS = 32, 250_000, 1_024, 8

#: Hash slots by which texts that a join does not need are told before it.
SLOTS = 1 << 20
SKETCH = "doc_id bigint, keys array<bigint>, n bigint, tokens array<bigint>"
_BITS = np.arange(64, dtype=np.uint64)
_TURNS = np.random.default_rng(SEED).integers(1 << 63, size=KEYS, dtype=np.uint64) | np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if set in over half of the shingles' XXH64. A text without
    words, or null, has 0; one with fewer words than a shingle is one shingle."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    hashed = xxhash.xxh64_intdigest
    if n < shingle:
        return hashed(b" ".join(words), SEED)
    n -= shingle - 1
    parts = zip(*(words[k:] for k in range(shingle)))
    hashes = np.fromiter((hashed(b" ".join(p), SEED) for p in parts), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        piece = hashes[i : i + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce(np.where(2 * ones > n, np.uint64(1) << _BITS, np.uint64(0))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, point``: the fingerprint as a signed 64-bit number. One row per
    input row, null ids and repeated rows included; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(points.view(np.int64))], ["doc_id", "point"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, point bigint")


def _apart(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point)


def _vantage(points: np.ndarray) -> tuple[np.uint64, int]:
    """The vantage point and distance that split best among a few candidates:
    the larger side and the points near the boundary should be few."""
    best, found = None, (points[0], 0)
    for point in points[np.linspace(0, len(points) - 1, 8).astype(int)]:
        apart = _apart(points[:: max(1, len(points) // 1024)], point)
        at = int(np.median(apart))
        for cut in (at - 1, at):
            left = np.count_nonzero(apart <= cut)
            cost = max(left, len(apart) - left) + np.count_nonzero((apart > cut) & (apart <= cut + RADIUS))
            if best is None or cost < best:
                best, found = cost, (point, cut)
    return found


def grow(points: np.ndarray, leaves: int) -> list[tuple]:
    """A tree as a list of nodes ``(point, cut, left, right)``; a child below 0
    is shard ``-1 - child``. The largest leaf is split next until there are
    ``leaves`` of them or none can be split."""
    nodes: list[list] = []
    heap = [(points, None)]
    while len(heap) < leaves:
        heap.sort(key=lambda x: len(x[0]))
        here, parent = heap.pop()
        if len(here) < 16:
            heap.append((here, parent))
            break
        point, cut = _vantage(here)
        near = _apart(here, point) <= cut
        if near.all() or not near.any():
            heap.insert(0, (here[:8], parent))  # all alike: a leaf
            continue
        if parent:
            nodes[parent[0]][parent[1]] = len(nodes)
        nodes.append([point, cut, None, None])
        heap += [(here[near], (len(nodes) - 1, 2)), (here[~near], (len(nodes) - 1, 3))]
    for shard, (_, parent) in enumerate(heap):
        if parent:
            nodes[parent[0]][parent[1]] = -1 - shard
    return [tuple(n) for n in nodes]


def route(nodes: list[tuple], points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """``(shard, positions, visiting)``: every point belongs to one shard and
    visits those where a neighbour left of one of its boundaries may be."""
    todo = [(0 if nodes else -1, np.arange(len(points)), False)]
    while todo:
        node, rows, visiting = todo.pop()
        if not len(rows):
            continue
        if node < 0:
            yield -1 - node, rows, visiting
            continue
        point, cut, left, right = nodes[node]
        apart = _apart(points[rows], point)
        if visiting:
            todo += [(left, rows[apart <= cut + radius], True), (right, rows[apart > cut - radius], True)]
        else:
            near = apart <= cut
            todo += [(left, rows[near], False), (right, rows[~near], False), (left, rows[~near & (apart <= cut + radius)], True)]


def links(points: np.ndarray, visiting: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest, as pairs of positions, of all links between the points
    of a shard and between those and its visitors."""
    parent = np.arange(len(points))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept: list[tuple[int, int]] = []

    def compare(rows: np.ndarray, own: np.ndarray) -> None:
        step = max(1, BLOCK // max(1, len(own)))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            a, b = np.nonzero(np.bitwise_count(points[part, None] ^ points[None, own]) <= radius)
            a, b = part[a], own[b]
            for x, y in zip(a[a != b].tolist(), b[a != b].tolist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    kept.append((x, y))

    todo = [(np.flatnonzero(~visiting), np.flatnonzero(visiting))]
    while todo:
        own, guests = todo.pop()
        if not len(own):
            continue
        if len(own) * (len(own) + len(guests)) > BLOCK:
            point, cut = _vantage(points[own])
            far, seen = _apart(points[own], point), _apart(points[guests], point)
            near = far <= cut
            left = (own[near], np.concatenate([guests[seen <= cut + radius], own[~near & (far <= cut + radius)]]))
            right = (own[~near], guests[seen > cut - radius])
            whole = len(own) * (len(own) + len(guests))
            if sum(len(x) * (len(x) + len(y)) for x, y in (left, right)) < 0.9 * whole:
                todo += [left, right]
                continue
        compare(np.concatenate([own, guests]), own)
    return np.array(kept, np.int64).reshape(-1, 2)


def linked(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between distinct values of the column ``point`` that
    connect the same points as all pairs within ``radius`` bits do."""
    n = points.count()
    sample = points.orderBy(F.xxhash64("point"), "point").limit(SAMPLE).toArrow().column(0).to_numpy()
    nodes = grow(sample.view(np.uint64), -(-n // SHARD))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            for shard, rows, visiting in route(nodes, own.view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), shard)), pa.array(own[rows]), pa.array(np.full(len(rows), visiting))],
                    ["shard", "point", "visiting"],
                )

    def solve(key: tuple, shard: pa.Table) -> pa.Table:
        own = shard.column("point").to_numpy()
        pairs = links(own.view(np.uint64), shard.column("visiting").to_numpy(), radius)
        return pa.table({"a": own[pairs[:, 0]], "b": own[pairs[:, 1]]})

    dealt = points.mapInArrow(deal, "shard bigint, point bigint, visiting boolean")
    return dealt.groupBy("shard").applyInArrow(solve, "a bigint, b bigint")


def roots(edges: DataFrame) -> DataFrame:
    """``point, root`` for every point that an edge ``a, b`` names; points of a
    component share the root. Alternates large and small stars; every round's
    edges are written, and the rounds end when a round changes nothing. A hub's
    minimum combines before the shuffle, and only its edges are joined to it."""
    pair = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.inline(F.array(pair("u", "v"), pair("v", "u"))))

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    now, before = written(edges, "links"), None
    while (seen := state(now)) != before:
        before = seen
        ways = both(now)
        large = ways.where("v > u").join(least(ways), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = least(down)
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "links")
    return now.select(F.col("u").alias("point"), F.col("v").alias("root"))


def components(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, point, component_id`` from ``doc_id, point``: the smallest
    doc_id of all documents reachable over links of at most ``radius`` bits.

    Rows stay as they are, repeated ones too. Null ids take part, but are no
    component's smallest unless all its ids are null. An empty table gives none."""
    marked = written(marked, "points")
    points = marked.groupBy("point").agg(F.min("doc_id").alias("least"))
    found = roots(linked(points.select("point"), radius))
    rooted = points.join(found, "point", "left").select("point", "least", F.coalesce("root", "point").alias("root"))
    rooted = written(rooted, "roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("point", "component_id"), "point")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``; see
    ``fingerprint`` for texts without words and ``components`` for odd ids."""
    found = components(fingerprints(docs, id_col, text_col, shingle), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int = WORDS) -> np.ndarray:
    """Distinct XXH64 of a text's word shingles; one if it has fewer words, none
    without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts), np.uint64))


def _keys(own: np.ndarray) -> list[int]:
    """A fingerprint of the PICKED shingles that come first in each of KEYS orders."""
    out = []
    for k, turn in enumerate(_TURNS):
        order = own * turn
        order ^= order >> np.uint64(31)
        first = np.sort(np.partition(order, PICKED - 1)[:PICKED] if len(order) > PICKED else order)
        digest = xxhash.xxh64_intdigest(first.tobytes(), k)
        out.append(digest - (1 << 64) if digest >> 63 else digest)
    return out


def ordered(late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles sorted for lookups, and the place of each in ``late``."""
    places = np.argsort(late)
    return late[places], places


def _prefix(own: np.ndarray, common: np.ndarray, places: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, so many that a similar set has one of them among
    its own first: by hash, but those in ``common`` (sorted) last, by ``places``."""
    size = len(own) - _least(len(own), similarity) + 1
    if not len(common):
        return own[:size]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    known = common[at] == own
    plain = own[~known][:size]
    if len(plain) == size:
        return plain
    late = own[known][np.argsort(places[at[known]])]
    return np.concatenate([plain, late[: size - len(plain)]])


def _least(n: int, similarity: float) -> int:
    """Shingles that a set of ``n`` shares with a similar one at least."""
    return max(1, math.ceil(similarity * n - 1e-9))


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``a, b``: links between documents whose sets of five-word shingles have a
    Jaccard similarity of ``similarity`` or more; copies are linked to the first.
    They connect the same documents as all such pairs do.

    In the first pass a text meets at most two others for each of its keys; the
    second one compares what that left in different groups. Null ids, and texts
    without words, take no part."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a row at a time: sets are as large as texts
                own = shingle_set(b.column(1)[i].as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 1], pa.array([own], pa.list_(pa.int64()))], ["doc_id", "own"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null")
    named = written(rows.select("doc_id", F.xxhash64("text").alias("mark"), F.octet_length("text").alias("size")), "marks")
    first = named.groupBy("mark", "size").agg(F.min("doc_id").alias("first"))
    same = written(named.join(first, ["mark", "size"]).where("doc_id <> first").select("doc_id", "first").distinct(), "copies")
    once = rows.join(same.select("doc_id"), "doc_id", "left_anti")

    def frequent(texts: DataFrame, n: int, least: int = 0) -> np.ndarray:
        """The shingles of most texts in a sample of ``n`` texts, in rising order;
        such as are in ``least`` of all, if the sample shows it."""
        every = max(1, -(-n // LOOKED))
        sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
        counted = sample.mapInArrow(sets, "doc_id bigint, own array<bigint>").select(F.explode("own").alias("token")).groupBy("token").count()
        top = counted.where(F.col("count") >= max(OFTEN, least // every)).orderBy(F.desc("count"), "token").limit(LAST).toArrow()
        return top.column(0).to_numpy().view(np.uint64)[::-1]

    late = frequent(once, named.count())

    def sketched(late: np.ndarray, with_keys: bool):
        order = ordered(late)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    part, keys, sizes, tokens = b.slice(i, 256), [], [], []
                    for t in part.column(1):
                        own = shingle_set(t.as_py())
                        keys.append(_keys(own) if with_keys and len(own) else [])
                        sizes.append(len(own))
                        tokens.append(_prefix(own, *order, similarity).view(np.int64) if len(own) else [])
                    of = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(keys, of), pa.array(sizes, pa.int64()), pa.array(tokens, of)], ["doc_id", "keys", "n", "tokens"]
                    )

        return run

    def holding(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
        """Ids of the texts that have one of these among their ``tokens``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(1)
                hit = np.isin(lists.flatten().to_numpy(), wanted)
                rows = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                yield b.select(["doc_id"]).take(pa.array(np.unique(rows[hit])))

        return texts.mapInArrow(run, "doc_id bigint").distinct()

    def settled(sketch: DataFrame, joined: DataFrame) -> DataFrame:
        """``doc_id, n, tokens`` in an order where shingles that crowd the first
        places of texts of different groups come last of all. Only texts that have
        one of these among their first get new ones: for others nothing moves."""
        inside = joined.where("point <> root").select(F.col("point").alias("doc_id"))
        apart = sketch.join(inside, "doc_id", "left_anti").select("doc_id", "tokens")
        counted = apart.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") > HOT)
        crowded = counted.orderBy(F.desc("count"), "token").limit(LAST).toArrow().column(0).to_numpy()
        touched = written(holding(apart, crowded), "touched")
        more = frequent(among(once, touched), touched.count(), HOT)
        more = more[~np.isin(more, late)]
        changed = written(holding(sketch.select("doc_id", "tokens"), more.view(np.int64)), "changed")
        again = among(once, changed).mapInArrow(sketched(np.concatenate([late, more]), False), SKETCH).drop("keys")
        out = written(without(sketch.drop("keys"), changed).union(again), "settled")
        discard(touched, changed)
        return out

    def one_each(texts: DataFrame) -> DataFrame:
        """Of rows under one id the least text."""
        return texts.groupBy("doc_id").agg(F.min("text").alias("text"))

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of the distinct ``a, b`` whose sets are similar."""
        asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        own = written(one_each(among(rows, asked)).mapInArrow(sets, "doc_id bigint, own array<bigint>"), "sets")
        left, right = (own.select(F.col("doc_id").alias(c), F.col("own").alias(f"own_{c}")) for c in "ab")
        # sizes alone tell most pairs apart before the sets are moved
        sizes = own.select("doc_id", F.size("own").alias("n"))
        close = (
            pairs.join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a")), "a")
            .join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b")), "b")
            .where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")).select("a", "b")
        )
        both = F.size(F.array_intersect("own_a", "own_b"))
        enough = both >= similarity * (F.size("own_a") + F.size("own_b") - both)
        out = written(close.join(left, "a").join(right, "b").where(enough).select("a", "b"), "similar")
        discard(own, pairs)
        return out

    sketch = written(once.mapInArrow(sketched(late, True), SKETCH), "sketches")
    keys = sketch.select("doc_id", F.explode("keys").alias("key"))
    ends = keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    met = keys.join(ends, "key").select("doc_id", F.explode(F.array("low", "high")).alias("other")).where("doc_id <> other")
    found = alike(written(met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct(), "pairs"))
    joined = roots(found)
    first = settled(sketch, joined)
    discard(sketch)
    shared = _apart_yet(first, joined)
    discard(first)
    rest = alike(written(_pairs_apart(shared, similarity), "pairs"))
    hot = shared.where(F.col("strays") > HOT)
    named = roots(hot.select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()).withColumnRenamed("point", "doc_id")
    blocks = named.union(named.select("root", "root")).distinct()
    own = one_each(among(rows, blocks.select("doc_id"))).mapInArrow(sets, "doc_id bigint, own array<bigint>")
    held = written(own.join(blocks, "doc_id"), "hot")
    dense = _cells(held, similarity)
    discard(held, shared)
    return found.union(rest).union(dense).union(same.select(F.col("first").alias("a"), F.col("doc_id").alias("b")))


def among(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id is in ``asked``. Texts whose id shares no hash
    slot with any of these, of which there are ``SLOTS``, are not moved."""
    return _by_slot(texts, asked, "left_semi").join(asked, "doc_id", "left_semi")


def without(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The other rows of ``texts``, most of which are not moved either."""
    return _by_slot(texts, asked, "left_anti").union(_by_slot(texts, asked, "left_semi").join(asked, "doc_id", "left_anti").select(*texts.columns))


def _by_slot(texts: DataFrame, asked: DataFrame, how: str) -> DataFrame:
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")
    return texts.select("*", slot).join(F.broadcast(asked.select(slot).distinct()), "slot", how).select(*texts.columns)


def _apart_yet(sketch: DataFrame, joined: DataFrame) -> DataFrame:
    """``doc_id, n, at, token`` for the first shingles that texts of different
    groups ``joined`` so far share, with the text's group ``root``, the
    largest group ``main``, the smallest id ``least`` and the number of texts outside
    the largest group, ``strays``."""
    group = joined.select(F.col("point").alias("doc_id"), "root")
    # a shingle's rows move once, as narrow ones; most go where they arrive
    own = sketch.join(group, "doc_id", "left").select("doc_id", "n", F.coalesce("root", "doc_id").alias("root"), F.posexplode("tokens").alias("at", "token"))
    own = own.select("token", "doc_id", "root", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("bigint")).alias("place"))
    of = W.partitionBy("token")
    several = own.withColumn("low", F.min("root").over(of)).withColumn("high", F.max("root").over(of)).where("low < high")
    place = F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND((1 << 32) - 1).alias("at")
    met = written(several.select("doc_id", *place, "root", "token"), "met")
    heavy = joined.groupBy("root").agg(F.count("*").alias("weight"))
    weight = F.coalesce("weight", F.lit(0)).alias("weight")
    weighed = met.join(heavy, "root", "left").select("token", "doc_id", F.struct(weight, "root").alias("group"))
    main = weighed.groupBy("token").agg(F.max("group")["root"].alias("main"), F.min("doc_id").alias("least"))
    met = met.join(main, "token")
    strays = met.where("root <> main").groupBy("token").agg(F.count("*").alias("strays"))
    shared = written(met.join(strays, "token"), "shared")
    discard(met)
    return shared


def _pairs_apart(shared: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: the pairs of different groups that may be similar and share only
    first shingles of at most HOT strays; others may be among them."""
    few = shared.where(F.col("strays") <= HOT)
    columns = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("doc_id", "n", "root", "at")]
    # of two groups one is not the largest
    met = few.where("root <> main").select("token", "main", *columns("a")).join(few.select("token", *columns("b")), "token")
    need = F.ceil(similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6)
    bound = F.least("at_a", "at_b") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    met = met.where(
        (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main")) | (F.col("doc_id_a") < F.col("doc_id_b")))
        & (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6) & (bound >= need)
    )
    one, two = F.struct("doc_id_a", "n_a"), F.struct("doc_id_b", "n_b")
    as_b = F.struct(F.col("doc_id_b").alias("doc_id_a"), F.col("n_b").alias("n_a")), F.struct(F.col("doc_id_a").alias("doc_id_b"), F.col("n_a").alias("n_b"))
    turned = F.col("doc_id_a") > F.col("doc_id_b")
    met = met.select(F.when(turned, as_b[0]).otherwise(one).alias("one"), F.when(turned, as_b[1]).otherwise(two).alias("two"))
    counted = met.select("one.*", "two.*").groupBy("doc_id_a", "doc_id_b", "n_a", "n_b").agg(F.count("*").alias("both"))
    # so many at most are beyond a set's first shingles
    rest = F.ceil(similarity * F.greatest("n_a", "n_b") - 1e-6) - 1
    return counted.where(F.col("both") + rest >= need).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def forest(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs, as positions: all pairs where
    ``side`` is 0 for all, else those of a 0 and a 1. Pairs are compared TILE by TILE
    sets, so that memory follows the shingles and not the pairs."""
    order = np.argsort(side, kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    rows = np.repeat(np.arange(len(order)), sizes)
    _, token, times = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    kept = times[token] > 1
    rows, token = rows[kept], token[kept]
    label, out = np.arange(len(order)), []

    def held(at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(rows, [at, min(at + TILE, end)])
        return rows[lo:hi] - at, token[lo:hi]

    def present(own: np.ndarray, places: np.ndarray, at: int, width: int, height: int) -> np.ndarray:
        here = (places >= at) & (places < at + width)
        found = np.zeros((height, width), np.float32)
        found[own[here], places[here] - at] = 1
        return found

    stop = int(np.count_nonzero(side == 0))
    for i in range(0, stop, TILE):
        one, tokens = held(i, stop)
        for j in range(i if stop == len(order) else stop, len(order), TILE):
            two, others = held(j, len(order))
            common = np.intersect1d(tokens, others)
            if not len(common):
                continue
            own = np.isin(tokens, common), np.isin(others, common)
            at_one, at_two = (np.searchsorted(common, x[y]) for x, y in zip((tokens, others), own))
            n, m = sizes[i : min(i + TILE, stop)], sizes[j : j + TILE]
            both = np.zeros((len(n), len(m)), np.float32)
            for at in range(0, len(common), PIECE // 4):
                width = min(PIECE // 4, len(common) - at)
                both += present(one[own[0]], at_one, at, width, len(n)) @ present(two[own[1]], at_two, at, width, len(m)).T
            close = (both >= similarity * (n[:, None] + m[None, :] - both.astype(np.float64))) & (both > 0)
            for x in (np.flatnonzero(close.any(axis=1)) + i).tolist():
                y = np.flatnonzero(close[x - i]) + j
                y = y[label[y] != label[x]]
                if len(y):
                    far, which = np.unique(label[y], return_index=True)
                    label[np.isin(label, far)] = label[x]
                    out += [(int(order[x]), int(order[k])) for k in y[which]]
    return out


def _classes(n: Column, similarity: float) -> Column:
    """Classes of set sizes: similar sets are in the same one or in neighbours."""
    return F.floor(F.log(n) / (max(-math.log(similarity), 1e-6) + 1e-9))


def _cells(own: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links that connect what all similar pairs inside each ``root`` do,
    from ``doc_id, root, own``. A root of up to HELD shingles is one block. Others are
    cut into blocks by size of set, every two of the same or of neighbouring classes
    meet in one task. Blocks are files that tasks read: a set is moved and stored once,
    however many blocks its own one meets."""
    size = F.size("own")
    large = written(own.groupBy("root").agg(F.sum(size).alias("shingles")).where(F.col("shingles") > HELD).select("root"), "large")

    def compared(ids: np.ndarray, lists: pa.ListArray, side: np.ndarray) -> pa.RecordBatch:
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        pairs = forest([values[x:y] for x, y in zip(ends, ends[1:])], side, similarity)
        pairs = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], ["a", "b"])

    def solve(key: tuple, root: pa.Table) -> pa.Table:
        ids = root.column("doc_id").to_numpy()
        return pa.Table.from_batches([compared(ids, root.column("own").combine_chunks(), np.zeros(len(ids), int))])

    small = own.join(large, "root", "left_anti").groupBy("root").applyInArrow(solve, "a bigint, b bigint")
    if large.isEmpty():
        out = written(small, "dense")
        discard(large)
        return out

    classed = own.join(large, "root").withColumn("class", _classes(size, similarity))
    slots = classed.groupBy("root", "class").agg(F.ceil(F.sum(size) / HELD).alias("slots"))
    dealt = classed.join(written(slots, "slots"), ["root", "class"]).withColumn("slot", F.pmod(F.xxhash64("doc_id"), "slots"))
    folder = fresh_path(own.sparkSession, "blocks")
    blocks = dealt.select("doc_id", "own", F.concat_ws("_", "root", "class", "slot").alias("block"))
    blocks.repartition("block").sortWithinPartitions("block").write.option("compression", "zstd").partitionBy("block").parquet(folder)
    one = written(dealt.select("root", "class", "slot").distinct(), "slots")
    two = one.select("root", F.col("class").alias("other"), F.col("slot").alias("with"))
    cells = one.join(two, "root").where("other = class + 1 or (other = class and slot <= with)")
    names = F.concat_ws("_", "root", "class", "slot").alias("one"), F.concat_ws("_", "root", "other", "with").alias("two")
    cells = written(cells.select(*names), "cells")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        store, base = fs.FileSystem.from_uri(folder)
        held = {}

        def read(block: str) -> pa.Table:
            if block not in held:
                held[block] = dataset.dataset(f"{base}/block={block}", filesystem=store, format="parquet").to_table(["doc_id", "own"])
            return held[block]

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for block in held.keys() - {x, y}:
                    del held[block]
                parts = [read(x)] if x == y else [read(x), read(y)]
                side = np.repeat(np.arange(len(parts)), [p.num_rows for p in parts])
                cell = pa.concat_tables(parts).combine_chunks()
                yield compared(cell.column("doc_id").to_numpy(), cell.column("own").combine_chunks(), side)

    tasks = cells.repartition(-(-cells.count() // CELLS)).sortWithinPartitions("one", "two")
    out = written(small.union(tasks.mapInArrow(meet, "a bigint, b bigint")), "dense")
    discard(large, one, cells, own.sparkSession.read.schema("doc_id bigint").parquet(folder))
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows whose id is the smallest of their group, columns as given. A group
    is connected by fingerprints within ``radius`` bits and by ``similar_links``.
    Rows with a null id have no name to be found by and all stay."""
    with batches_of(docs.sparkSession, TEXTS):
        near = near_duplicates(docs, id_col, text_col, radius=radius).where("doc_id <> component_id")
        edges = near.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
        found = roots(edges.union(similar_links(docs, id_col, text_col)))
    return docs.join(found.select(F.col("point").alias(id_col)).distinct(), id_col, "left_anti").select(*docs.columns)
