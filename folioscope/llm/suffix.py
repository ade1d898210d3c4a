"""Removal of bytes that repeat an earlier document, by collection suffix arrays.

A byte goes if a string of WINDOW bytes that covers it also starts in a document
with a smaller id. Exact copies of an earlier document go whole at once. Other texts
are joined to blocks, kept in a table bucketed by block. Windows with equal bytes
have equal anchors (see ``anchors``), so:

1. blocks tell which anchors they have; those of two documents or more are kept;
2. neighbouring windows of such an anchor make one string; equal strings are
   folded to one with the smallest id of its documents before they are shuffled;
3. the strings of an anchor meet in one task, which builds the Burrows-Wheeler
   transform and common prefixes of its collection column by column (see
   ``collection``) and reads from it the smallest id of each window. An anchor
   with a single string is the trivial collection and needs no building. The
   windows of an anchor with very many strings are dealt out one by one;
4. the blocks get the strings' results back and cut their texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import anchors
from folioscope.llm.anchors import WINDOW
from folioscope.llm.collection import window_minima
from folioscope.llm.common import fresh_path, written

#: Bytes of a block, anchors that meet in a group, strings that are built together.
BLOCK, MEET, TOGETHER = 1 << 20, 1 << 18, 12_000
#: Exact copies up to which their digests go to every executor (40 bytes each);
#: beyond it the join shuffles.
SENT = 500_000
#: Anchors of several strings up to which they go to every executor.
SENT_ANCHORS = 1_000_000
#: Strings of one anchor beyond which its windows go separate ways.
HOT = 8_000
#: Stands for a null id: larger than any.
LAST = np.iinfo(np.int64).max
_BITS = 48


def blocks(docs: DataFrame) -> DataFrame:
    """``block, ids, sizes, data``: texts of ``doc_id, text`` joined to blocks of
    about BLOCK bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, parts, size = TaskContext.get().partitionId() << 33, [], [], 0

        def flush() -> pa.RecordBatch:
            kind = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([ids], kind), pa.array([list(map(len, parts))], kind), pa.array([b"".join(parts)], pa.binary())],
                ["block", "ids", "sizes", "data"],
            )

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                ids.append(doc.as_py())
                parts.append((text.as_py() or "").encode())
                size += len(parts[-1])
                if size >= BLOCK:
                    yield flush()
                    number, ids, parts, size = number + 1, [], [], 0
        if ids:
            yield flush()

    spark = docs.sparkSession
    made = docs.mapInArrow(run, "block bigint, ids array<bigint>, sizes array<bigint>, data binary")
    name = f"llm_blocks_{uuid.uuid4().hex}"
    made.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option(
        "path", fresh_path(spark, "blocks")
    ).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Bytes, ends of texts and runs of a block; anchors are cut to _BITS bits."""
    data = np.frombuffer(row["data"].as_buffer(), np.uint8)
    ends = np.cumsum(row["sizes"].values.to_numpy())
    anchor, first, count, text = anchors.runs(data, ends)
    return data, ends, (anchor >> np.uint64(64 - _BITS), first, count, text)


def _only(table: pa.Table) -> dict:
    return {c: table.column(c)[0] for c in table.column_names}


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _BITS // 8].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // _BITS, 8), np.uint8)
    out[:, : _BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, _BITS // 8)
    return out.view("<u8").ravel()


def _inside(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def met_anchors(table: DataFrame, groups: int) -> DataFrame:
    """``block, part, bits``: which of a block's distinct anchors, in order and by
    part of their range, another block has too."""
    width = np.uint64(-(-(1 << _BITS) // groups))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(k)[i] for k, c in enumerate(("block", "sizes", "data"))}
                own = np.unique(_opened(row)[2][0])
                part, at = np.unique(own // width, return_index=True)
                held = [_packed(x) for x in np.split(own, at[1:])] if len(own) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int64)), pa.array(np.full(len(held), row["block"].as_py(), np.int64)), pa.array(held, pa.binary())],
                    ["part", "block", "anchors"],
                )

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        held = [_unpacked(x) for x in group.column("anchors").to_pylist()]
        every = np.sort(np.concatenate(held))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        bits = [np.packbits(_inside(x, twice)).tobytes() for x in held]
        found = pa.table({"block": group.column("block"), "part": group.column("part"), "bits": pa.array(bits, pa.binary())})
        return found.filter(pa.array([any(x) for x in bits], pa.bool_()))

    told = table.select("block", "sizes", "data").mapInArrow(tell, "part bigint, block bigint, anchors binary")
    return told.groupBy("part").applyInArrow(meet, "block bigint, part bigint, bits binary")


def strings(table: DataFrame, met: DataFrame, groups: int) -> DataFrame:
    """``block, anchor, string, least, most``: the strings of shared anchors of
    each block, once, with the smallest and largest id of their documents."""
    width = np.uint64(-(-(1 << _BITS) // groups))
    schema = pa.schema([("block", pa.int64()), ("anchor", pa.int64()), ("string", pa.binary()), ("least", pa.int64()), ("most", pa.int64())])

    def run(key: tuple, block: pa.Table, replies: pa.Table) -> pa.Table:
        row = _only(block)
        data, _, (anchor, first, count, text) = _opened(row)
        ids = np.array([LAST if x is None else x for x in row["ids"].as_py()], np.int64)
        order = np.argsort(anchor, kind="stable")  # texts rise within an anchor
        ranked = anchor[order]
        begin = np.flatnonzero(np.diff(ranked, prepend=~ranked[:1]))
        own = ranked[begin]
        part = own // width
        shared = np.zeros(len(own), bool)
        for which, bits in zip(replies.column("part").to_pylist(), replies.column("bits").to_pylist()):
            a, b = np.searchsorted(part, np.array([which, which + 1], np.uint64))
            shared[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        if len(own):
            texts = text[order]
            shared |= texts[begin] != texts[np.append(begin[1:], len(order)) - 1]  # two texts of this block
        keep = order[np.repeat(shared, np.diff(begin, append=len(order)))]
        raw, found = data.tobytes(), {}
        at = zip(first[keep].tolist(), (first[keep] + count[keep] + WINDOW - 1).tolist())
        which = np.fromiter((found.setdefault(raw[x:y], len(found)) for x, y in at), np.int64, len(keep))
        of, least, most = np.zeros(len(found), np.uint64), np.full(len(found), LAST), np.full(len(found), np.iinfo(np.int64).min)
        of[which] = anchor[keep]  # a string's bytes tell its anchor
        np.minimum.at(least, which, ids[text[keep]])
        np.maximum.at(most, which, ids[text[keep]])
        return pa.table(
            [
                pa.array(np.full(len(found), key[0].as_py(), np.int64)), pa.array(of.view(np.int64)),
                pa.array(list(found), pa.binary()), pa.array(least), pa.array(most),
            ],
            schema=schema,
        )

    pairs = table.groupBy("block").cogroup(met.groupBy("block"))
    return pairs.applyInArrow(run, "block bigint, anchor bigint, string binary, least bigint, most bigint")


def minima(found: DataFrame, together: int = TOGETHER, hot: int = HOT) -> DataFrame:
    """``anchor, name, minima`` for strings of which a window must go in some document:
    the smallest id of each window, or one number if it is the same for all.
    ``name`` is the string's XXH64."""

    def solve(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("string")
        least, most = (group.column(c).to_numpy() for c in ("least", "most"))
        texts = group.column("string").to_pylist()
        low = window_minima(texts, least, WINDOW)
        every, sizes = np.concatenate(low), np.fromiter(map(len, low), np.int64, len(low))
        begin = np.cumsum(sizes) - sizes
        smallest, largest = np.minimum.reduceat(every, begin), np.maximum.reduceat(every, begin)
        out = np.flatnonzero(smallest < most)
        told = np.where(smallest == largest, 1, sizes)[out]
        ends = np.cumsum(told)
        at = np.repeat(begin[out], told) + np.arange(told.sum()) - np.repeat(ends - told, told)
        return pa.table({
            "anchor": group.column("anchor").take(pa.array(out)),
            "name": group.column("name").take(pa.array(out)),
            "minima": pa.LargeListArray.from_arrays(pa.array(np.append(0, ends)), pa.array(every[at])).cast(pa.list_(pa.int64())),
        })

    name = F.xxhash64("string").alias("name")
    least, most = F.min("least").alias("least"), F.max("most").alias("most")
    # most anchors have a single string, so its windows all have its smallest id
    each = written(
        found.select("anchor", name, "least", "most").groupBy("anchor")
        .agg(F.min("name").alias("name"), F.max("name").alias("other"), least, most), "anchors",
    )
    alone = each.where("name = other and least < most").select("anchor", "name", F.array("least").alias("minima"))
    several = each.where("name <> other").select("anchor")
    few = several.count() <= SENT_ANCHORS
    once = found.join(F.broadcast(several) if few else several, "anchor", "left_semi")
    once = written(once.groupBy("anchor", "string").agg(least, most), "several")
    many = written(once.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"), "hot")
    groups = max(1, -(-once.count() // together))

    def built(rows: DataFrame) -> DataFrame:
        dealt = rows.select(F.pmod("anchor", F.lit(groups)).alias("part"), "anchor", "string", name, "least", "most")
        return dealt.groupBy("part").applyInArrow(solve, "anchor bigint, name bigint, minima array<bigint>")

    if many.isEmpty():
        return built(once).union(alone)
    # every window of a hot anchor becomes a string of its own, with its own anchor
    cut = F.transform(F.sequence(F.lit(1), F.octet_length("string") - (WINDOW - 1)), lambda i: F.substring("string", i, F.lit(WINDOW)))
    windows = written(once.join(many, "anchor", "left_semi").select("anchor", name, "least", "most", F.posexplode(cut).alias("at", "string")), "windows")
    single = windows.groupBy("string").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    solved = built(single.select(F.xxhash64("string").alias("anchor"), "string", "least", "most"))
    solved = solved.select(F.col("name").alias("window"), F.get("minima", F.lit(0)).alias("low"))
    whole = (
        windows.withColumn("window", F.xxhash64("string")).join(solved, "window", "left")
        .groupBy("anchor", "name").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("low", "least").alias("low")))).alias("all"))
        .select("anchor", "name", F.transform("all", lambda x: x["low"]).alias("minima"))
    )
    return built(once.join(many, "anchor", "left_anti")).union(whole).union(alone)


def cut_blocks(table: DataFrame, results: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` from the results ``block, anchor, name, minima``."""

    def run(key: tuple, block: pa.Table, replies: pa.Table) -> pa.Table:
        row = _only(block)
        data, ends, (anchor, first, count, text) = _opened(row)
        given = row["ids"].as_py()
        ids = np.array([LAST if x is None else x for x in given], np.int64)
        names, lists = replies.column("name").to_numpy(), replies.column("minima").combine_chunks()
        raw, starts = data.tobytes(), np.zeros(len(data), bool)
        some = np.flatnonzero(_inside(anchor, np.unique(replies.column("anchor").to_numpy().astype(np.uint64))))
        if len(some):
            at = zip(first[some].tolist(), (first[some] + count[some] + WINDOW - 1).tolist())
            name = np.fromiter((xxhash.xxh64_intdigest(raw[x:y], 42) for x, y in at), np.uint64, len(some)).view(np.int64)
            order = np.argsort(names)
            place = np.minimum(np.searchsorted(names[order], name), len(names) - 1)
            reply = order[place]
            hit = names[reply] == name
            some, reply = some[hit], reply[hit]
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            run = np.repeat(np.arange(len(some)), count[some])
            step = np.arange(len(run)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            each = np.diff(offsets)[reply] > 1  # else one number stands for all windows
            low = values[offsets[reply][run] + np.where(each[run], step, 0)]
            gone = low < ids[text[some]][run]
            starts[(first[some][run] + step)[gone]] = True
        before = np.concatenate([np.zeros(WINDOW, np.int64), np.cumsum(starts)])
        out = before[WINDOW:] > before[:-WINDOW]
        begin, spans, kept = 0, [], []
        for end in ends.tolist():
            own = out[begin:end]
            edge = np.flatnonzero(np.diff(own, prepend=False, append=False))
            spans.append(edge)
            kept.append(data[begin:end][~own].tobytes())
            begin = end
        edges = np.concatenate(spans).reshape(-1, 2)
        pair = pa.StructArray.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["start", "stop"])
        upto = np.append(0, np.cumsum([len(x) // 2 for x in spans])).astype(np.int32)
        return pa.table({
            "doc_id": pa.array(given, pa.int64()), "n_bytes": pa.array(np.diff(ends, prepend=0), pa.int64()),
            "spans": pa.ListArray.from_arrays(pa.array(upto), pair), "kept": pa.array(kept, pa.binary()),
        })

    pairs = table.groupBy("block").cogroup(results.groupBy("block"))
    return pairs.applyInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def copies(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows that are no exact copy of a row with a smaller id, and
    ``doc_id, size`` of those that are and have a window: nothing of them stays."""
    identity, text = F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    rows = docs.select(identity, text)
    digest, size = F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("bigint").alias("size")
    marks = written(rows.where(F.octet_length("text") >= WINDOW).select("doc_id", digest, size), "digests")
    first = marks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    gone = written(marks.join(first, "digest").where("doc_id is null or doc_id > first").select("doc_id", "digest", "size"), "copies")
    names = gone.select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    few = names.count() <= SENT
    kept = rows.join(
        F.broadcast(names) if few else names,
        F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.unhex(F.sha2("text", 256)) == F.col("gone_digest")), "left_anti",
    )
    return kept, gone.select("doc_id", "size")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row of ``docs``: the byte spans
    that go, and the bytes that stay (which may cut a character).

    A null text is empty. Rows with one id cut nothing from each other; a null id
    counts as larger than all others. Other columns are ignored."""
    rest, gone = copies(docs, id_col, text_col)
    table = blocks(rest)
    total = table.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()[0] or 0
    groups = max(1, -(-total // (14 * MEET)))
    met = met_anchors(table, groups)
    found = written(strings(table, met, groups), "strings")
    low = written(minima(found, together, hot), "minima")
    results = found.select("block", "anchor", F.xxhash64("string").alias("name")).join(low, ["anchor", "name"])
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("size").alias("stop"))).alias("spans")
    nothing = F.lit("").cast("binary").alias("kept")
    return cut_blocks(table, results).union(gone.select("doc_id", F.col("size").alias("n_bytes"), whole, nothing))
