"""Heuristic fact extraction: sections to entity and relationship rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.vocabulary import (
    ARTICLES,
    CLAIM_NUMBER,
    CUES,
    DATASETS,
    MAX_NAME_WORDS,
    METRICS,
    NAME_WORD,
    claim_sentences as claim_array,
    cue_names as cue_array,
    vocabulary_hits,
)
from folioscope.operators.structure import sections_by_type

# Fixed values.
HEURISTIC, HEURISTIC_CONFIDENCE = "heuristic", 0.6
CLAIM_MARK = " \N{EM DASH} claim "


def vocab_match(df: DataFrame, text_col: str, vocabulary: list[str], out: str = "name") -> DataFrame:
    """One row per distinct vocabulary name found in the text."""
    hits = vocabulary_hits(F.col(text_col), vocabulary)
    return df.withColumn(out, F.explode(hits))


def _folded(c: Column) -> Column:
    """Lower case letter by letter, also of those whose upper case is another's."""
    return F.lower(F.translate(c, "\u0130\u0131\u017f\u00b5\u03c2", "iis\u03bc\u03c3"))


# a word and what stands before it, as group 0; the word, as group 1
PIECE = r"(?U)\W*(\w+)"


def _forms(pieces: Column, words: Column, shape: Column) -> Column:
    """Every run of ``shape.words`` words as it stands, with the characters before its
    first word (``lead``) or after its last one (``trail``) up to the neighbouring word."""
    n = shape["words"]

    def form(i: Column) -> Column:
        opening = F.when(~shape["lead"], F.get(words, i)).when(i > 0, F.get(pieces, i))
        after = F.get(pieces, i + n)
        gap = F.left(after, F.length(after) - F.length(F.get(words, i + n)))
        closing = F.when(shape["trail"], gap).otherwise("")
        return F.concat(opening, F.array_join(F.slice(pieces, i + 2, n - 1), ""), closing)

    last = F.size(words) - n
    return F.when(last >= 0, F.array_compact(F.transform(F.sequence(F.lit(0), last), form)))


def match_names(
    df: DataFrame, text_col: str, names: DataFrame, name_col: str = "name", out: str = "name"
) -> DataFrame:
    """``vocab_match`` for a vocabulary that is a table of any size: one row per row of
    ``df`` and distinct name found in its text, by an equi-join instead of one pattern.

    A name stands in a text as whole words exactly if the text has a run of as many words
    that reads the same, case aside; a name that begins or ends with another character must
    have just this between it and the next word. So texts send their distinct runs, of the
    word counts that names have, and these meet names by equality. What a text sends is
    its words times the distinct word counts of names, however many names there are.

    Null texts and texts without words have no names. Null and empty names, and names without
    a letter, digit or underscore, match nothing; repeated names count once; spellings that
    differ in case alone are all found. Repeated rows of ``df`` are found each. The result
    has the columns of ``df`` without the text, which would travel with every run; a
    column named ``out`` is replaced.
    """
    folded = _folded(F.col("_name"))
    known = (
        names.select(F.col(name_col).alias("_name")).distinct()
        .where(F.col("_name").rlike(r"(?U)\w"))
        .select(
            "_name", folded.alias("_form"),
            F.struct(
                F.size(F.regexp_extract_all(folded, F.lit(PIECE), F.lit(1))).alias("words"),
                folded.rlike(r"(?U)^\W").alias("lead"), folded.rlike(r"(?U)\W\z").alias("trail"),
            ).alias("_shape"),
        )
    )
    # at most four for each word count that names have
    shapes = known.agg(F.collect_set("_shape").alias("_shapes"))
    text = _folded(F.col(text_col))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (out, text_col)]
    cut = df.select(F.struct(*kept).alias("_row"), text.alias("_text")).crossJoin(
        F.broadcast(shapes)  # exactly one row
    ).select(
        "_row", "_shapes",
        F.regexp_extract_all("_text", F.lit(PIECE), F.lit(0)).alias("_pieces"),
        F.regexp_extract_all("_text", F.lit(PIECE), F.lit(1)).alias("_words"),
    )
    runs = F.transform("_shapes", lambda s: _forms(F.col("_pieces"), F.col("_words"), s))
    return (
        cut.select("_row", F.explode(F.array_distinct(F.flatten(F.array_compact(runs)))).alias("_form"))
        .join(known.select("_form", "_name"), "_form")
        .select("_row.*", F.col("_name").alias(out))
    )


def cue_names(
    df: DataFrame,
    text_col: str,
    cues: list[str] = CUES,
    name_word: str = NAME_WORD,
    max_words: int = MAX_NAME_WORDS,
    articles: list[str] = ARTICLES,
) -> DataFrame:
    """One row per name announced by a cue phrase, with its position from 0."""
    names = cue_array(F.col(text_col), cues, name_word, max_words, articles)
    return df.select("*", F.posexplode(names).alias("pos", "name"))


def claim_sentences(
    df: DataFrame, text_col: str, number_pattern: str = CLAIM_NUMBER
) -> DataFrame:
    """One row per quantified sentence, with its position from 0."""
    claims = claim_array(F.col(text_col), number_pattern)
    return df.select("*", F.posexplode(claims).alias("pos", "sentence"))


def _fact(kind: str, edge: str, name: Column, description: Column, evidence: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("entity_type"),
        F.lit(edge).alias("relationship_type"),
        name.alias("name"),
        description.cast("string").alias("description"),
        evidence.alias("evidence"),
    )


def extract_facts(
    sections: DataFrame,
    papers: DataFrame,
    datasets: list[str] = DATASETS,
    metrics: list[str] = METRICS,
    cues: list[str] = CUES,
    name_word: str = NAME_WORD,
    articles: list[str] = ARTICLES,
    number_pattern: str = CLAIM_NUMBER,
) -> DataFrame:
    """One row per extracted fact: the entity and the edge from its paper.

    Methods come from methodology and introduction text, datasets from all
    sections, metrics from experiments and results, claims from results (or
    experiments where results is missing). Papers without sections give nothing.
    """
    texts = sections_by_type(sections).join(
        papers.select("paper_id", "title", F.col("ord").alias("paper_ord")), "paper_id"
    )

    def of(kind: str) -> Column:
        return F.coalesce(F.try_element_at("sections", F.lit(kind)), F.lit(""))

    scoped = texts.select(
        "paper_id",
        "title",
        "paper_ord",
        F.concat_ws(" ", of("methodology"), of("introduction")).alias("method_text"),
        F.concat_ws(" ", of("experiments"), of("results")).alias("metric_text"),
        of("results").alias("results_text"),
        F.array_join(F.map_values("sections"), " ").alias("all_text"),
    )
    found = scoped.select(
        "paper_id",
        "title",
        "paper_ord",
        cue_array(F.col("method_text"), cues, name_word, articles=articles).alias("methods"),
        vocabulary_hits(F.col("all_text"), datasets).alias("datasets"),
        vocabulary_hits(F.col("metric_text"), metrics).alias("metrics"),
        claim_array(
            F.when(F.col("results_text") != "", F.col("results_text")).otherwise(
                F.col("metric_text")
            ),
            number_pattern,
        ).alias("claims"),
    )
    none = F.lit(None)
    quoted = lambda n: F.concat(F.lit("'"), n, F.lit("'"))
    facts = F.concat(
        F.transform(
            "methods",
            lambda n: _fact(
                "method", "proposes", n, none,
                F.concat(F.lit("'we propose/introduce/present "), n, F.lit("' found in text")),
            ),
        ),
        F.transform(
            "datasets",
            lambda n: _fact(
                "dataset", "evaluated_on", n, none,
                F.concat(quoted(n), F.lit(" mentioned in paper text")),
            ),
        ),
        F.transform(
            "metrics",
            lambda n: _fact(
                "metric", "mentions", n, none,
                F.concat(quoted(n), F.lit(" mentioned in experiments/results")),
            ),
        ),
        F.transform(
            "claims",
            lambda s, i: _fact(
                "claim", "mentions",
                F.concat(F.col("title"), F.lit(CLAIM_MARK), (i + 1).cast("string")), s, s,
            ),
        ),
    )
    return found.select("paper_id", "title", "paper_ord", F.posexplode(facts).alias("ord", "f")).select(
        "paper_id",
        "title",
        "paper_ord",
        "ord",
        "f.*",
        F.lit(HEURISTIC).alias("extraction_method"),
        F.lit(HEURISTIC_CONFIDENCE).alias("confidence"),
    )


def entity_rows(facts: DataFrame) -> DataFrame:
    return facts.select(
        "paper_id", "paper_ord", "ord", "entity_type", "name", "description",
        "extraction_method", "confidence",
    )


def relationship_rows(facts: DataFrame) -> DataFrame:
    return facts.select(
        "paper_id", "ord", F.col("title").alias("source_name"), F.col("name").alias("target_name"),
        "relationship_type", "evidence", "confidence",
    )


def extract_knowledge(sections: DataFrame, papers: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(raw_entities, raw_relationships) of every paper; options as in extract_facts."""
    facts = extract_facts(sections, papers, **options)
    return entity_rows(facts), relationship_rows(facts)
