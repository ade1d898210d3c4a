"""Quality rules: weak votes, accuracies by expectation-maximisation, posterior verdict.

Each rule looks at a few counts of a document and votes good (1) or bad (-1), or
abstains (0). The rules' accuracies and the share of good documents are estimated
from the votes alone: the corpus is reduced to its vote patterns (at most 3 to the
number of rules, whatever the corpus size) and expectation-maximisation runs over
that one-row summary as a SQL expression. A document's quality is the posterior
probability that it is good. Everything is a DataFrame expression; there is no
Python code at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SPACES, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ROUNDS = 25
KEEP_AT = 0.5
#: Accuracies stay in this range: a rule is better than a coin and never certain.
ACCURACY = (0.55, 0.98)
#: Nor is the corpus wholly good or wholly bad.
PRIOR = (0.05, 0.95)
#: Where the estimates start, and how many imaginary documents hold them there.
START_ACCURACY, START_PRIOR, WEIGHT = 0.9, 0.75, 20.0


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _joined(hashes: Column, step: int) -> Column:
    """Each hash mixed with the one ``step`` places on; the last ones stand alone."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(F.size(hashes), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Counts of each document: ``n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_distinct, n_upper`` beside ``doc_id``; with ``carry`` the
    whole input row as the struct ``row``.

    A null text has no words and counts of 0. Rows are independent: equal ids,
    repeated rows and null ids give a row each. Other input columns are ignored
    (or carried) and may have any name. Windows are compared by 64-bit hash and
    sorted with their places, so a text of n words takes n log n steps.
    """
    given = [F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")]
    rows = docs.select(*given, *([F.struct("*").alias("row")] if carry else []))
    also = ["row"] if carry else []
    text, words, hashes, placed, starts = (F.col(c) for c in ("text", "words", "hashes", "placed", "starts"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    basic = rows.select(
        "doc_id", *also, "text", _words(text).alias("words"), lines.alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    counted = basic.select(
        "doc_id", *also, "n_symbols",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_upper"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"),
    )
    others = [c for c in counted.columns if c != "hashes"] + ["n_distinct"]
    # hashes of windows of 2, 4 and then 8 words, each from two of the size before
    counted = counted.withColumn("n_distinct", F.size(F.array_distinct(hashes)).cast("long"))
    for step in (1, 2, 4):
        counted = counted.select(*others, _joined(hashes, step).alias("hashes"))
    counted = counted.select(
        *others, F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))).alias("hashes")
    )
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    ordered = counted.select(
        *[c for c in counted.columns if c != "hashes"],
        F.when(repeats, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
        .otherwise(none).alias("placed"),
    )

    def again(x: Column, i: Column) -> Column:
        near = lambda j: F.coalesce(F.get(placed, j)["h"] == x["h"], F.lit(False))
        return near(i - 1) | near(i + 1)

    found = ordered.select(
        *[c for c in ordered.columns if c != "placed"],
        F.sort_array(F.transform(F.filter(placed, again), lambda x: x["at"])).alias("starts"),
    )
    covered = F.aggregate(
        F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    return found.select(
        *[c for c in found.columns if c != "starts"], covered.cast("long").alias("n_repeat_words")
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def votes() -> Column:
    """One vote per rule, from the counts of ``measure``. Eight rules each know
    one kind of junk and abstain elsewhere; the last one knows plain prose."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    symbols, upper = F.col("n_symbols") / n, F.col("n_upper") / chars
    same_lines, repeated = F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n
    mean, distinct = chars / n, F.col("n_distinct") / F.least(n, F.lit(200))
    bad = lambda c: F.when(c, -1).otherwise(0)
    prose = (n >= MIN_WORDS) & mean.between(3, 12) & (symbols < 0.05) & (upper < 0.1) & (distinct > 0.3) & (repeated < 0.3)
    return F.array(
        bad(F.col("n_words") < MIN_WORDS),
        bad((mean < 2) | (mean > 20)),
        bad(symbols > 0.2),
        bad(F.col("n_symbols") / chars > 0.04),
        bad(upper > 0.4),
        bad((same_lines > 0.5) & (repeated > 0.3)),
        bad(repeated > 0.3),
        bad(distinct < 0.2),
        F.when(prose, 1).otherwise(0),
    )


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _posterior(vote: Column, prior: Column, accuracy: Column) -> Column:
    """Probability of good: prior odds times the odds of each vote cast."""
    odds = F.aggregate(F.zip_with(vote, accuracy, lambda v, a: v * _logit(a)), _logit(prior), lambda s, x: s + x)
    return 1 / (1 + F.exp(-odds))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fit(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row ``prior double, accuracy array<double>`` from a column ``votes``.

    The patterns are sorted before they are summed, so the result does not depend
    on how rows were dealt out. An empty table gives the starting values.
    """
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    whole = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    rules = F.coalesce(F.size(F.get(F.col("patterns"), F.lit(0))["votes"]), F.lit(0))
    start = F.struct(
        F.lit(START_PRIOR).alias("prior"),
        F.when(rules > 0, F.array_repeat(F.lit(START_ACCURACY), rules)).otherwise(F.array().cast("array<double>")).alias("accuracy"),
    )
    patterns_col = F.col("patterns")

    def total(items: Column, of) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda s, x: s + of(x))

    def maximise(q: Column, state: Column) -> Column:
        prior = (total(q, lambda x: x["n"] * x["q"]) + WEIGHT * START_PRIOR) / (total(q, lambda x: x["n"]) + WEIGHT)

        def accuracy(_: Column, r: Column) -> Column:
            vote = lambda x: F.get(x["votes"], r)
            right = total(q, lambda x: F.when(vote(x) == 1, x["n"] * x["q"]).when(vote(x) == -1, x["n"] * (1 - x["q"])).otherwise(0.0))
            cast = total(q, lambda x: F.when(vote(x) != 0, x["n"]).otherwise(0.0))
            value = (right + WEIGHT * START_ACCURACY) / (cast + WEIGHT)
            return F.least(F.lit(ACCURACY[1]), F.greatest(F.lit(ACCURACY[0]), value))

        return F.struct(
            F.least(F.lit(PRIOR[1]), F.greatest(F.lit(PRIOR[0]), prior)).alias("prior"),
            F.transform(state["accuracy"], accuracy).alias("accuracy"),
        )

    def step(state: Column, _: Column) -> Column:
        expected = F.transform(
            patterns_col,
            lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), _posterior(p["votes"], state["prior"], state["accuracy"]).alias("q")),
        )
        return _let(expected, lambda q: maximise(q, state))

    model = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return whole.select(model.alias("model")).select("model.prior", "model.accuracy")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The counts of ``measure`` with ``votes``, ``quality`` (posterior probability
    of good) and ``kept``: not ``base_failed``, and quality of KEEP_AT or more.

    The counts are written to the shared folder once; fitting and judging read
    them. Nulls, repeated rows and empty tables: see ``measure`` and ``fit``.
    """
    voted = written(measure(docs, id_col, text_col, carry).withColumn("votes", votes()), "quality")
    model = fit(voted.select("votes"))
    return (
        voted.crossJoin(F.broadcast(model))  # one row
        .withColumn("quality", _posterior(F.col("votes"), F.col("prior"), F.col("accuracy")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))
        .drop("prior", "accuracy")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns."""
    return judge(docs, carry=True).where("kept").select("row.*")
