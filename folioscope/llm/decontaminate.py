"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

An item's windows of WINDOW consecutive words are sets of word shingles with
places. A window occurs in a document only if all its shingles do, so one of
them, the rarest in the corpus, is a sufficient prefix: the document's shingles
meet the benchmark's, rarity is counted from what met, each window asks only
for the places of its rarest shingle, the place in the window and both lengths
bound where it can start, and the window is verified shingle by shingle at the
places where it must be. Overlapping shingles at consecutive places hold all the
words, so this check is exact.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import written

WINDOW = 10
SHINGLE = 3
#: Distinct benchmark shingles up to which they are sent to every executor
#: (about 100 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 200_000

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of ASCII letters and digits and of all other characters
    beyond ASCII; none for null."""
    small = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(small, BETWEEN, -1), "")


def _shingles(all_words: Column, size: int) -> Column:
    last = F.size(all_words) - size
    joined = lambda i: F.concat_ws(" ", *[F.get(all_words, i + k) for k in range(size)])
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), joined)
    )


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item_id, win, width, size, parts``: an item's distinct windows, their
    words, their shingles' size and the shingles in order. Items without words
    have none; an item shorter than ``window`` is one window."""
    w, width, size = F.col("w"), F.col("width"), F.col("size")
    cut = (
        items.select(F.col(f"`{id_col}`").alias("item_id"), words(F.col(f"`{text_col}`")).alias("w"))
        .where(F.size("w") > 0)
        .withColumn("width", F.least(F.size("w"), F.lit(window)))
        .withColumn("size", F.least(width, F.lit(SHINGLE)))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - width + 1)))
        .select("item_id", "width", "size", F.slice(w, F.col("at"), width).alias("w"))
    )
    parts = F.transform(
        F.sequence(F.lit(1), width - size + 1), lambda i: F.array_join(F.slice(w, i, size), " ")
    )
    return cut.select("item_id", F.array_join(w, " ").alias("win"), "width", "size", parts.alias("parts")).distinct()


def _met(docs: DataFrame, wins: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, mark, n_words, size, at, part`` for every place of a document
    that has a shingle of the benchmark, and one row per document with the empty
    shingle of size 0."""
    wanted = written(wins.select("size", F.explode("parts").alias("part")).distinct(), "shingles")
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())  # SHINGLE rows at most
    few = wanted.count() <= BROADCAST_ROWS
    text = F.col(f"`{text_col}`")
    split = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("mark"), words(text).alias("w"))
    found = None
    for first, size in [(k == 0, x) for k, x in enumerate(sizes or [SHINGLE])]:
        parts, own = _shingles(F.col("w"), size), wanted.where(F.col("size") == size).select("part")
        if first:  # the same pass over the texts also yields a row for each document
            parts = F.concat(F.array(F.lit("")), parts)
            own = own.union(docs.sparkSession.range(1).select(F.lit("").alias("part")))
        rows = (
            split.select("doc_id", "mark", F.size("w").cast("long").alias("n_words"), F.posexplode(parts).alias("at", "part"))
            .join(F.broadcast(own) if few else own, "part")
            .select(
                "doc_id", "mark", "n_words", F.when(F.col("part") == "", 0).otherwise(size).alias("size"),
                (F.col("at") - int(first)).alias("at"), "part",
            )
        )
        found = rows if found is None else found.union(rows)
    return written(found, "met")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """``doc_id, mark, n_words, n_hit, item_ids, contaminated`` per document.

    A word is hit inside any occurrence of a window; ``item_ids`` are the items,
    as strings in order, with occurring windows. A document is a doc_id (null is
    one too) with a text, ``mark`` being the text's hash: repeated rows give one
    result. Null and empty texts have no words. Without items nothing is hit.
    """
    wins = written(windows(items, item_col, item_text_col, window), "windows")
    met = _met(docs, wins, id_col, text_col)
    places = met.where("size > 0")
    rarity = places.groupBy("size", "part").agg(F.count("*").alias("often"))
    shapes = wins.select("win", "width", "size", "parts").distinct()
    prefix = (
        shapes.select("win", "width", "size", F.posexplode("parts").alias("lead", "part"))
        .join(rarity, ["size", "part"], "left")
        .groupBy("win", "width", "size")
        .agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "lead", "part")).alias("rare"))
        .where("rare.often > 0")
        .select("win", "width", "size", "rare.lead", "rare.part")
    )
    start = (F.col("at") - F.col("lead")).alias("start")
    candidates = (
        places.join(prefix, ["size", "part"])
        .select("doc_id", "mark", "n_words", start, "win", "width", "size")
        .where((F.col("start") >= 0) & (F.col("start") + F.col("width") <= F.col("n_words")))
        .distinct()
    )
    needed = candidates.join(shapes.select("win", "parts"), "win").select(
        "doc_id", "mark", "start", "win", "width", "size", F.size("parts").alias("need"),
        F.posexplode("parts").alias("lead", "part"),
    )
    p, q = places.alias("p"), needed.alias("q")
    occurring = (
        q.join(
            p,
            F.col("p.doc_id").eqNullSafe(F.col("q.doc_id")) & (F.col("p.mark") == F.col("q.mark"))
            & (F.col("p.at") == F.col("q.start") + F.col("q.lead"))
            & (F.col("p.size") == F.col("q.size")) & (F.col("p.part") == F.col("q.part")),
        )
        .select("q.doc_id", "q.mark", "q.start", "q.win", "q.width", "q.need", "q.lead")
        .groupBy("doc_id", "mark", "start", "win", "width", "need")
        .agg(F.count_distinct("lead").alias("have"))
        .where("have = need")
    )
    occurring = written(occurring.select("doc_id", "mark", "start", "win", "width"), "occurring")
    doc = Window.partitionBy("doc_id", "mark").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("width")
    hits = (
        occurring.select("doc_id", "mark", "start", end.alias("end")).distinct()
        .withColumn("before", F.coalesce(F.max("end").over(doc), F.lit(0)))
        .groupBy("doc_id", "mark")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).alias("n_hit"))
    )
    named = (
        occurring.select("doc_id", "mark", "win").distinct().join(wins.select("win", "item_id"), "win")
        .groupBy("doc_id", "mark")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    base = met.where("size = 0").select("doc_id", "mark", "n_words").distinct()
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark"))
    return (
        base.alias("d").join(hits.alias("h"), same("d", "h"), "left").join(named.alias("i"), same("d", "i"), "left")
        .select(
            "d.doc_id", "d.mark", "d.n_words", F.coalesce("h.n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("i.item_ids", F.array().cast("array<string>")).alias("item_ids"),
            (F.coalesce("h.n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text``, any others) in which no window
    of an item occurs, columns as given."""
    gone = contamination(docs, items).where("contaminated").select("doc_id", "mark")
    d, g = docs.alias("d"), gone.alias("g")
    return d.join(
        g, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.mark")), "left_anti"
    ).select("d.*")
