"""Citation matching: which corpus titles occur inside which references.

The rule is containment of one normalised string in another, for every pair.
Comparing every pair is quadratic, so pairs are first found by equi-joins on
keys that any containment must share, then verified with ``contains``:

* three or more words: every inner word of the title is a whole word of the
  reference, its left neighbour ends in the same character and its right
  neighbour starts with the same character. The rarest inner word of the title
  is its key; a title with an inner word found in no reference drops out.
* two words: the first ends, the second starts a word of the reference. The
  longer of the two has at least ``(min_title_length - 1) / 2`` characters, so
  that many characters of it and one of the other make the key.
* one word: it lies inside one long word, whose substrings of the minimum title
  length are its keys.

Keys are 64-bit hashes: a collision adds a candidate, which the check removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.text import normalize_title

MIN_TITLE_LENGTH = 15


def _inner_key(words: Column, i: Column) -> Column:
    return F.xxhash64(
        F.lit("inner"),
        F.right(F.get(words, i - 1), F.lit(1)),
        F.get(words, i),
        F.left(F.get(words, i + 1), F.lit(1)),
    )


def _inner_keys(words: Column) -> Column:
    return F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: _inner_key(words, i)),
    ).otherwise(F.array().cast("array<bigint>"))


def _pair_keys(words: Column, half: int) -> Column:
    """Keys of every adjacent word pair, for the long-left and the long-right case."""

    def of(i: Column) -> Column:
        left, right = F.get(words, i - 1), F.get(words, i)
        return F.array_compact(
            F.array(
                F.when(
                    F.length(left) >= half,
                    F.xxhash64(F.lit("left"), F.right(left, F.lit(half)), F.left(right, F.lit(1))),
                ),
                F.when(
                    F.length(right) >= half,
                    F.xxhash64(F.lit("right"), F.right(left, F.lit(1)), F.left(right, F.lit(half))),
                ),
            )
        )

    return F.when(
        F.size(words) >= 2,
        F.flatten(F.transform(F.sequence(F.lit(1), F.size(words) - 1), of)),
    ).otherwise(F.array().cast("array<bigint>"))


def _within_keys(words: Column, length: int) -> Column:
    """Keys of every substring of the minimum title length inside one word."""
    long = F.filter(words, lambda w: F.length(w) >= length)
    return F.flatten(
        F.transform(
            long,
            lambda w: F.transform(
                F.sequence(F.lit(1), F.length(w) - (length - 1)),
                lambda i: F.xxhash64(F.lit("within"), F.substr(w, i, F.lit(length))),
            ),
        )
    )


def _lengths(min_title_length: int) -> tuple[int, int]:
    return max(1, min_title_length // 2), max(1, min_title_length)


def reference_keys(words: Column, min_title_length: int = MIN_TITLE_LENGTH) -> Column:
    """All keys by which the words of a reference can be found."""
    half, length = _lengths(min_title_length)
    return F.concat(_inner_keys(words), _pair_keys(words, half), _within_keys(words, length))


def _short_key(norm: Column, words: Column, min_title_length: int) -> Column:
    """The key of a title of one or two words."""
    half, length = _lengths(min_title_length)
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    return (
        F.when(F.size(words) == 1, F.xxhash64(F.lit("within"), F.left(norm, F.lit(length))))
        .when(
            F.length(first) >= half,
            F.xxhash64(F.lit("left"), F.right(first, F.lit(half)), F.left(second, F.lit(1))),
        )
        .otherwise(F.xxhash64(F.lit("right"), F.right(first, F.lit(1)), F.left(second, F.lit(half))))
    )


def title_key(norm: Column, min_title_length: int = MIN_TITLE_LENGTH) -> Column:
    """One key that every reference holding the title has, whatever else the corpus
    holds: of the longest inner word, the first of several. For key tables that
    outlive a run, where counts of words would change under them."""
    words = F.split(norm, " ")
    at = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: F.struct(F.length(F.get(words, i)).alias("n"), (-i).alias("i"))
    )
    longest = -F.array_max(at)["i"]
    return F.when(F.size(words) >= 3, _inner_key(words, longest)).otherwise(_short_key(norm, words, min_title_length))


def citation_match(
    references: DataFrame, papers: DataFrame, min_title_length: int = MIN_TITLE_LENGTH
) -> DataFrame:
    """All (reference, cited paper) pairs where the cited title occurs in the reference.

    references: (paper_id, reference_id, raw_text); papers: (paper_id, title).
    A reference is never matched to its own paper. Equal titles are matched once
    and expanded at the end.
    """
    titled = papers.select("paper_id", "title", normalize_title(F.col("title")).alias("norm")).where(
        F.length("norm") >= max(1, min_title_length)
    )
    titles = titled.select("norm").distinct().withColumn("words", F.split("norm", " "))
    n = F.size("words")

    # reference side: keys only, the text stays behind until verification
    ref_words = references.select(
        "reference_id", F.split(normalize_title(F.col("raw_text")), " ").alias("words")
    )
    ref_keys = ref_words.select(
        "reference_id", F.explode(reference_keys(F.col("words"), min_title_length)).alias("key")
    )

    inner = titles.where(n >= 3).select(
        "norm", F.posexplode(_inner_keys(F.col("words"))).alias("pos", "key")
    )
    frequency = (
        ref_keys.join(inner.select("key").distinct(), "key", "left_semi")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    rarest = (
        inner.join(frequency, "key", "left")
        .groupBy("norm")
        .agg(
            F.min_by("key", F.struct("df", "pos")).alias("key"),
            F.count_if(F.col("df").isNull()).alias("absent"),
        )
        .where(F.col("absent") == 0)
        .select("norm", "key")
    )
    short = titles.where(n <= 2).select("norm", _short_key(F.col("norm"), F.col("words"), min_title_length).alias("key"))
    candidates = (
        ref_keys.join(rarest.unionByName(short), "key").select("reference_id", "norm").distinct()
    )
    verified = (
        references.select(
            "paper_id", "reference_id", normalize_title(F.col("raw_text")).alias("norm_ref")
        )
        .join(candidates, "reference_id")
        .where(F.contains(F.col("norm_ref"), F.col("norm")))
        .select("paper_id", "reference_id", "norm", F.length("norm_ref").alias("ref_length"))
    )
    cited = titled.select(
        F.col("paper_id").alias("cited_paper_id"), F.col("title").alias("cited_title"), "norm"
    )
    share = F.length("norm") / F.greatest(F.col("ref_length"), F.lit(1))
    return (
        verified.join(cited, "norm")
        .where(~F.col("paper_id").eqNullSafe(F.col("cited_paper_id")))
        .select(
            "paper_id",
            "reference_id",
            "cited_paper_id",
            "cited_title",
            F.round(F.least(F.lit(1.0), share + 0.4), 2).alias("match_confidence"),
        )
    )
