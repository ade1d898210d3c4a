"""Cost-balanced packing of tokenised documents into sequences.

Attention over n tokens costs about ``linear * n + quadratic * n * n``. Documents
are dealt by hash to shards of about SHARD documents. In a shard, documents are
cut into pieces of at most one sequence; whole sequences stand alone, and of the
others the costliest goes first, each to the sequence that costs least so far
among those with room. A piece that fits nowhere whole is cut to fill the one with
most room, so a shard leaves less than one sequence of padding.
"""

from __future__ import annotations

import os
import re
import threading
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 1024
END = 0
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SHARD = 1024
#: Chunks of text whose ids a worker remembers, in each of two generations.
MEMORY = 400_000
#: Seconds without a task after which a worker forgets them.
IDLE = 5
#: Texts are looked at in parts of about so many bytes.
PART = 4 << 20

_ODD = re.compile(r"\s |\x00")
_CUT = re.compile(r"(?<=\S)(?= )")
_READY: dict[str, Ids] = {}


class Ids:
    """Token ids of texts by a tokenizer file, as packed integers.

    The tokenizer's pattern never crosses a space that follows another kind of
    character, so a text is cut there and a chunk met before is not encoded again.
    Chunks are kept in two generations: a full one becomes the old one, from which
    those that occur again move on, so frequent chunks are never forgotten by a worker
    at work. One at rest holds no memory beside later steps."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are text
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.lock = threading.Lock()
        self.idle: threading.Timer | None = None

    def begin(self) -> None:
        if self.idle:
            self.idle.cancel()

    def end(self) -> None:
        self.idle = threading.Timer(IDLE, self.forget)
        self.idle.daemon = True
        self.idle.start()

    def forget(self) -> None:
        with self.lock:
            self.known, self.old = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        with self.lock:
            return self._encoded(texts)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        cut = [_CUT.split(t) if _ODD.search(t) else t.replace(" ", "\0 ").split("\0") for t in texts]
        if len(self.known) > MEMORY:
            self.known, self.old = {}, self.known
        missing = set().union(*cut).difference(self.known)
        again = missing & self.old.keys()
        self.known.update((c, self.old[c]) for c in again)
        new = list(missing - again)
        if new:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            packed = np.fromiter(chain.from_iterable(ids), self.kind).tobytes()
            ends = list(accumulate((len(x) * np.dtype(self.kind).itemsize for x in ids), initial=0))
            self.known.update(zip(new, (packed[a:b] for a, b in pairwise(ends))))
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]


def ids_of(path: str) -> Ids:
    """One per worker process and file."""
    if path not in _READY:
        _READY[path] = Ids(path)
    return _READY[path]


def tokenised(docs: DataFrame, tokenizer: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shard, doc_id, doc_tokens, start, ids``: pieces of at most LENGTH ids,
    the last ending with END. A null text is empty and so one END. A row's place
    takes part in its shard, so that repeated rows spread."""

    def parts(texts: list[str]) -> Iterator[tuple[int, int]]:
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > PART:
                yield first, i + 1
                first, size = i + 1, 0
        yield first, len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ids_of(tokenizer)
        own.begin()
        try:
            yield from pieces_of(own, batches)
        finally:
            own.end()

    def pieces_of(own: Ids, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, width = np.array([END], own.kind).tobytes(), np.dtype(own.kind).itemsize
        step = LENGTH * width
        for b in batches:
            texts = b.column(2).to_pylist()
            for first, last in parts(texts):
                rows, sizes, starts, pieces = [], [], [], []
                for i, packed in enumerate(own.encode(texts[first:last])):
                    packed += end
                    for at in range(0, len(packed), step):
                        rows.append(first + i)
                        sizes.append(len(packed) // width)
                        starts.append(at // width)
                        pieces.append(packed[at : at + step])
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(sizes, pa.int64()), pa.array(starts, pa.int64()), pa.array(pieces, pa.binary())],
                    ["shard", "doc_id", "doc_tokens", "start", "ids"],
                )

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    identity = F.col(f"`{id_col}`").cast("bigint")
    shard = F.pmod(F.xxhash64(identity, F.monotonically_increasing_id()), F.lit(shards)).alias("shard")
    return docs.select(shard, identity.alias("doc_id"), text).mapInArrow(
        run, "shard bigint, doc_id bigint, doc_tokens bigint, start bigint, ids binary"
    )


def assign(sizes: np.ndarray, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """``(piece, skip, size, sequence, offset)``: where each part of each piece
    goes. Pieces come in a fixed order, which decides ties; ``skip`` counts the
    piece's tokens before the part."""
    out, used = [], 0
    for i in np.flatnonzero(sizes >= length):
        out.append((int(i), 0, length, used, 0))
        used += 1
    rest = np.flatnonzero(sizes < length)
    n = -(-int(sizes[rest].sum()) // length)
    cost, room = np.zeros(n), np.full(n, length)
    todo = [(int(i), 0, int(sizes[i])) for i in rest[np.argsort(-sizes[rest], kind="stable")]]
    at = 0
    while at < len(todo):
        piece, skip, size = todo[at]
        at += 1
        fits = room >= size
        if fits.any():
            to, put = int(np.argmin(np.where(fits, cost, np.inf))), size
        else:
            to = int(np.argmax(room))
            put = int(room[to])
            todo.append((piece, skip + put, size - put))
        out.append((piece, skip, put, used + to, int(length - room[to])))
        room[to] -= put
        cost[to] += linear * put + quadratic * put * put
    return out


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    linear: float = LINEAR, quadratic: float = QUADRATIC,
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` per piece;
    ``ids`` are unsigned little-endian 32-bit integers.

    Every id of every row is in one piece. Rows are packed one by one: equal or
    null ids and repeated rows are documents of their own. Other columns are
    ignored. An empty table has no pieces. ``docs`` is read from a table, so that
    rows come in the same order where a lost task is run again."""
    shards = max(1, -(-docs.count() // SHARD))

    def solve(key: tuple, shard: pa.Table) -> pa.Table:
        kind = ids_of(tokenizer).kind
        shard = shard.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        pieces = [np.frombuffer(x, kind) for x in shard.column("ids").to_pylist()]
        put = assign(np.array([len(x) for x in pieces], np.int64), LENGTH, linear, quadratic)
        rows = pa.array([p[0] for p in put], pa.int64())
        skips, sizes, seq, offset = (np.array([p[k] for p in put], np.int64) for k in (1, 2, 3, 4))
        ids = [pieces[i][s : s + n].astype("<u4").tobytes() for i, s, n, _, _ in put]
        return pa.table({
            "doc_id": shard.column("doc_id").take(rows),
            "start": pa.array(shard.column("start").take(rows).to_numpy() + skips),
            "length": sizes,
            "doc_tokens": shard.column("doc_tokens").take(rows),
            "sequence_id": seq * shards + key[0].as_py(),
            "offset": offset,
            "ids": pa.array(ids, pa.binary()),
        })

    schema = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return tokenised(docs, tokenizer, shards, id_col, text_col).groupBy("shard").applyInArrow(solve, schema)


def digests(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
