"""Ranked lexical search over document shards, term at a time inside document at a time.

The index has one row per shard and term: places of documents in the shard, in
order of their ids, and how often they hold the term. A shard is a run of rows of
one input partition, so building the index shuffles nothing. Statistics come from
the index's counts; only lists of asked terms are read and sent to their shard.

In a shard, a query's short lists are summed term by term into accumulators. The
sums, ordered by document, are then one more iterator with a bound, beside the long
lists. The scan goes through windows of documents. In each, iterators whose bounds
together cannot beat the k-th score so far open no document; they are only looked
up, from the greatest bound down, for documents that still can. Shards return their
k best, and the best k of all follow.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import written
from folioscope.operators.ordering import first_k

TOP = 50
#: A shard ends at so many documents, or terms with repeats.
SHARD_DOCS, SHARD_TERMS = 8_192, 4_000_000
#: Documents of a window; queries that a shard answers at once, on average.
WINDOW, QUERIES = 1_024, 512
#: A list is short if it has at most one document in so many of the shard's.
SHORT = 64
#: Index rows handed to Spark at once.
ROWS = 16_384

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_FOLD = bytes(
    b if b > 127 or chr(b) in string.digits + _LOWER else ord(chr(b).lower()) if chr(b) in _UPPER else 32
    for b in range(256)
)
INDEX = "shard bigint, term string, df bigint, n_terms bigint, places array<int>, times array<int>, ids array<bigint>, lengths array<bigint>"


def terms(text: bytes | None) -> list[bytes]:
    """ASCII letters and digits and all other characters beyond ASCII make terms;
    only A-Z are lower-cased."""
    return (text or b"").translate(_FOLD).split()


def terms_of(text: Column) -> Column:
    """The same as a column."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))


def _lists(cuts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def _shard(number: int, ids: list, found: list[np.ndarray], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its documents, then its terms."""
    n = len(ids)
    order = sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lengths = np.array([len(x) for x in found], np.int64)
    keys, times = np.unique(np.concatenate(found) * n + np.repeat(place, lengths), return_counts=True)
    df = np.bincount(keys // n, minlength=len(known))
    cuts = np.concatenate([[0], np.cumsum(df)])
    names = pa.schema([
        ("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("n_terms", pa.int64()),
        ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ])
    yield pa.RecordBatch.from_pylist([{
        "shard": number, "term": None, "df": int(np.count_nonzero(lengths)), "n_terms": int(lengths.sum()),
        "ids": [ids[i] for i in order], "lengths": lengths[order].tolist(),
    }], names)
    rows = pa.RecordBatch.from_arrays([
        pa.array(np.full(len(known), number)), pa.array(list(known), pa.binary()).cast(pa.string()), pa.array(df),
        pa.nulls(len(known), pa.int64()), _lists(cuts, (keys % n).astype(np.int32)), _lists(cuts, times.astype(np.int32)),
        pa.nulls(len(known), pa.list_(pa.int64())), pa.nulls(len(known), pa.list_(pa.int64())),
    ], schema=names)
    for at in range(0, len(known), ROWS):
        yield rows.slice(at, ROWS)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of whole texts, written to the shared folder.

    Null and empty texts have no terms. Every row is a document of its own,
    repeated ids and rows too. Rows with a null id count in the statistics but are
    never listed. Other columns are ignored; an empty table gives an empty index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        ids, found, known = [], [], {}
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = [known.setdefault(t, len(known)) for t in terms(text.as_py())]
                ids.append(doc_id)
                found.append(np.array(own, np.int64))
                held += len(own)
                if len(ids) >= SHARD_DOCS or held >= SHARD_TERMS:
                    yield from _shard(number, ids, found, known)
                    number, held, ids, found, known = number + 1, 0, [], [], {}
        if ids:
            yield from _shard(number, ids, found, known)

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return written(rows.mapInArrow(run, INDEX), "index")


class Shard:
    """The lists of one shard, with their bounds by window."""

    def __init__(self, rows: pa.Table, n_docs: int, n_terms: int) -> None:
        rows = rows.combine_chunks()
        names = rows.column("term").to_pylist()
        own = names.index(None)
        ids = rows.column("ids")[own].as_py()
        self.n = sum(i is not None for i in ids)  # those without an id come last
        self.ids = np.array(ids[: self.n], np.int64)
        lengths = np.array(rows.column("lengths")[own].as_py(), np.int64)
        weight = 100 - 50 + 50 * lengths * n_docs // max(1, n_terms)
        at = np.flatnonzero([t is not None for t in names])
        lists = rows.take(pa.array(at)).combine_chunks()
        places, times = (np.concatenate([np.asarray(c.flatten()) for c in lists.column(x).chunks] or [np.empty(0, np.int32)]) for x in ("places", "times"))
        times = times.astype(np.int64)
        gains = 1_000_000_000 * times // (1000 * times + 20 * weight[places])
        cuts = np.concatenate([[0], np.cumsum(lists.column("df").to_numpy())]).astype(np.int64)
        self.starts = np.arange(0, self.n, WINDOW)
        self.lists = {}
        for k, t in enumerate(lists.column("term").to_pylist()):
            p, g = places[cuts[k] : cuts[k + 1]], gains[cuts[k] : cuts[k + 1]]
            listed = np.searchsorted(p, self.n)
            self.lists[t] = (p[:listed], g[:listed])
        self.bounds = {}

    def long(self, term: str) -> tuple:
        """A list, where its windows begin, and the greatest gain in each."""
        if term not in self.bounds:
            places, gains = self.lists[term]
            self.bounds[term] = (places, gains, *_windows(places, gains, self.starts))
        return self.bounds[term]

    def best(self, asked: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents with a score above 0."""
        asked = [(t, w) for t, w in asked if t in self.lists and len(self.lists[t][0])]
        sums, floor = np.zeros(self.n, np.int64), 0
        for t, w in asked:
            places, gains = self.lists[t]
            if len(places) * SHORT <= self.n:
                sums[places] += w * gains
        scans = [(*self.long(t), w) for t, w in asked if len(self.lists[t][0]) * SHORT > self.n]
        if len(held := np.flatnonzero(sums)):
            gathered = sums[held]
            scans.append((held, gathered, *_windows(held, gathered, self.starts), 1))
            if len(gathered) >= k:  # k documents reach this already
                floor = int(np.partition(gathered, -k)[-k]) - 1
        found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for at, start in enumerate(self.starts):
            bounds = np.array([w * tops[at] for *_, tops, w in scans], np.int64)
            order = np.argsort(bounds, kind="stable")
            reach = np.cumsum(bounds[order])
            first = int(np.searchsorted(reach, floor, "right"))  # iterators before it cannot beat the floor
            if first == len(order):
                continue
            part = np.zeros(min(WINDOW, self.n - start), np.int64)
            for i in order[first:]:
                places, gains, cuts, _, w = scans[i]
                here = slice(cuts[at], cuts[at + 1])
                part[places[here] - start] += w * gains[here]
            here = np.flatnonzero(part)
            for j in range(first - 1, -1, -1):
                here = here[part[here] + reach[j] > floor]
                if not len(here) or not bounds[order[j]]:
                    break
                places, gains, cuts, _, w = scans[order[j]]
                own = places[cuts[at] : cuts[at + 1]]
                spot = np.searchsorted(own, here + start)
                hit = spot < len(own)
                hit[hit] = own[spot[hit]] == here[hit] + start
                part[here[hit]] += w * gains[cuts[at] + spot[hit]]
            here = here[part[here] > floor]
            found, scores = np.concatenate([found, here + start]), np.concatenate([scores, part[here]])
            kept = np.argsort(-scores, kind="stable")[:k]  # earlier documents first among equals
            found, scores = found[kept], scores[kept]
            if len(scores) == k:
                floor = max(floor, int(scores[-1]))
        return found, scores


def _windows(places: np.ndarray, gains: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.concatenate([np.searchsorted(places, starts), [len(places)]])
    tops = np.zeros(len(starts), np.int64)
    some = cuts[1:] > cuts[:-1]
    if some.any():
        tops[some] = np.maximum.reduceat(gains, cuts[:-1][some])
    return cuts, tops


def search(index: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score above
    0 for each query, ties by doc_id.

    Rows of one query id are one query; its terms count once. Queries without a
    known term, and empty tables, give no rows. A null query id is an id."""
    asked = queries.select(F.col(f"`{id_col}`").alias("item_id"), F.explode(terms_of(F.col(f"`{text_col}`"))).alias("term")).distinct()
    asked = written(asked, "asked")
    parts = max(1, -(-asked.select("item_id").distinct().count() // QUERIES))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    docs, lists = index.where("term IS NULL"), index.where("term IS NOT NULL")
    n_docs, n_terms = docs.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    lists = lists.join(asked.select("part", "term").distinct(), "term")
    df = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(df.select("term", weight.alias("weight")), "term").where("weight > 0")
    packed = weighed.groupBy("part").agg(F.collect_list(F.struct("item_id", "term", "weight")).alias("asked"))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part")
    dealt = docs.select("*", each)
    visits = docs.select(F.col("shard").alias("at"), each).join(packed, "part")
    sent = dealt.unionByName(lists.select(*dealt.columns)).drop("n_terms")
    kind = queries.schema[id_col].dataType.simpleString()

    def run(own: pa.Table, asking: pa.Table) -> pa.Table:
        shard, ids, docs, ranked = Shard(own, n_docs, n_terms), [], [], []
        by_item: dict = {}
        for row in asking.column("asked").to_pylist():
            for q in row:
                by_item.setdefault(q["item_id"], []).append((q["term"], q["weight"]))
        for item, wanted in by_item.items():
            places, scores = shard.best(wanted, k)
            ids += [item] * len(places)
            docs.append(shard.ids[places])
            ranked.append(scores)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.table({"item_id": pa.array(ids, asking.schema.field("asked").type.value_type.field("item_id").type), "doc_id": join(docs), "score": join(ranked)})

    found = sent.groupBy("shard", "part").cogroup(visits.groupBy("at", "part")).applyInArrow(
        run, f"item_id {kind}, doc_id bigint, score bigint"
    )
    best = first_k(found, ["item_id"], [F.col("score").desc(), "doc_id"], k, "rank")
    return best.select("item_id", "rank", "doc_id", "score")
