"""Novelty of method names by word overlap with other names of the corpus.

A name is similar to another if that one holds at least half of its words. Work
is done on distinct word sets, never on mentions: equal names and re-orderings
collapse first, their number stays as a weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.session import settle

# Share of words that makes names similar, cost per similar name.
MIN_OVERLAP, PENALTY = 0.5, 0.3

# Names with more words than this are compared by prefix join, not by subset.
MAX_WORDS = 8


def words(name: Column) -> Column:
    return F.array_sort(
        F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0)))
    )


def _needed(column: str, min_overlap: float) -> Column:
    """Words of the set another name must hold to be similar."""
    return F.greatest(F.ceil(F.size(column) * min_overlap), F.lit(1)).cast("int")


def _prefix_pairs(left: DataFrame, right: DataFrame, min_overlap: float) -> DataFrame:
    """(words, other) with enough overlap. Only as many of the rarest words of the
    left set are looked up as guarantee one hit; hits are verified."""
    frequency = right.select(F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("df")
    )
    looked_up = F.size("words") - _needed("words", min_overlap) + 1
    probe = (
        left.select("words", F.explode("words").alias("word"))
        .join(frequency, "word", "left")
        .groupBy("words")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("r"))
        .select("words", F.explode(F.slice("r", F.lit(1), looked_up)).alias("r"))
        .select("words", F.col("r.word").alias("word"))
    )
    return (
        probe.join(right.select(F.col("words").alias("other"), F.explode("words").alias("word")), "word")
        .select("words", "other")
        .distinct()
        .where(F.size(F.array_intersect("words", "other")) >= _needed("words", min_overlap))
    )


def novelty_overlap(
    paper_concepts: DataFrame, min_overlap: float = MIN_OVERLAP
) -> DataFrame:
    """(method, similar, mentions): distinct method names and the names similar to
    them, with how often each similar name is mentioned in the corpus. A name is
    listed under itself when mentioned more than once (from another title)."""
    methods = paper_concepts.where(F.col("kind") == "method")
    names = (
        methods.groupBy(F.col("concept").alias("name"))
        .agg(
            F.count(F.lit(1)).alias("mentions"),
            (F.min("paper_title") != F.max("paper_title")).alias("elsewhere"),
        )
        .withColumn("words", words(F.col("name")))
        .where(F.size("words") > 0)
    )
    sets = names.select("words").distinct()
    pairs = _prefix_pairs(sets, sets, min_overlap)
    return (
        names.select(F.col("name").alias("method"), "words", "elsewhere")
        .join(pairs, "words")
        .join(
            names.select(
                F.col("name").alias("similar"), F.col("words").alias("other"), "mentions"
            ),
            "other",
        )
        .where((F.col("method") != F.col("similar")) | F.col("elsewhere"))
        .select("method", "similar", "mentions")
    )


def _largest(max_words: int, min_overlap: float) -> int:
    return max(1, math.ceil(max_words * min_overlap))


def _subsets(column: str, up_to: int) -> Column:
    """Non-empty subsets of at most ``up_to`` elements of a short sorted array."""
    return F.expr(
        f"filter(transform(sequence(1, cast(shiftleft(1, size({column})) - 1 as int)), "
        f"m -> filter({column}, (c, i) -> (shiftright(m, i) & 1) = 1)), s -> size(s) <= {up_to})"
    )


def novelty(
    paper_concepts: DataFrame,
    min_overlap: float = MIN_OVERLAP,
    penalty: float = PENALTY,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """(paper_title, method, mentions, novelty_score), one row per distinct pair.

    The score falls by ``penalty`` per similar mention and stops at 0, so beyond
    ``ceil(1 / penalty)`` mentions the number does not matter. A word subset big
    enough to decide similarity that this many mentions of other word sets hold
    settles the score at once; only below that are the few holders looked at.
    A word in a third of all names thus never yields pairs.
    """
    enough = math.ceil(1.0 / penalty) if penalty > 0 else 1 << 31
    entries = settle(
        paper_concepts.where(F.col("kind") == "method")
        .groupBy("paper_title", F.col("concept").alias("method"))
        .agg(F.count(F.lit(1)).alias("mentions"))
        .withColumn("words", words(F.col("method")))
    )
    sets = settle(
        entries.where(F.size("words") > 0)
        .groupBy("words")
        .agg(F.sum("mentions").alias("weight"))
    )
    narrow = sets.where(F.size("words") <= max_words)
    wide = sets.where(F.size("words") > max_words)

    held = narrow.select("words", "weight", F.explode(_subsets("words", _largest(max_words, min_overlap))).alias("subset"))
    holding = held.groupBy("subset").agg(F.sum("weight").alias("holding"))
    asked = held.where(F.size("subset") == _needed("words", min_overlap)).join(holding, "subset")
    crowded = (
        asked.where(F.col("holding") - F.col("weight") >= enough)
        .select("words")
        .distinct()
        .withColumn("saturated", F.lit(True))
    )
    sparse = asked.where(F.col("holding") - F.col("weight") < enough).join(
        crowded, "words", "left_anti"
    )
    near = (
        sparse.select("words", "subset")
        .join(held.select("subset", F.col("words").alias("other"), F.col("weight").alias("w")), "subset")
        .select("words", "other", "w")
    )
    far = (
        _prefix_pairs(wide, sets, min_overlap)
        .unionByName(_prefix_pairs(narrow, wide, min_overlap))
        .join(sets.select(F.col("words").alias("other"), F.col("weight").alias("w")), "other")
        .select("words", "other", "w")
    )
    total = near.unionByName(far).distinct().groupBy("words").agg(F.sum("w").alias("similar"))
    counted = sets.join(total, "words", "left").join(crowded, "words", "left")
    similar = F.coalesce(F.col("similar"), F.lit(0)) - F.col("mentions")
    score = (
        F.when(F.size("words") == 0, F.lit(1.0))
        .when(F.coalesce("saturated", F.lit(False)), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - F.lit(penalty) * similar))
    )
    return entries.join(
        counted.select("words", "similar", "saturated"), "words", "left"
    ).select("paper_title", "method", "mentions", F.round(score, 2).alias("novelty_score"))


def low_novelty(scores: DataFrame) -> DataFrame:
    """Methods whose name overlaps with another one."""
    return scores.where(F.col("novelty_score") < 1)
