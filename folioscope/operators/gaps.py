"""Research gaps and missing citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.functions.text import or_empty


def underexplored(paper_concepts: DataFrame) -> DataFrame:
    """Datasets listed exactly once in the corpus."""
    quoted = F.concat(F.lit("'"), F.col("concept"), F.lit("'"))
    return (
        paper_concepts.where(F.col("kind") == "dataset")
        .groupBy("concept")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == 1)
        .select(
            F.lit("underexplored_dataset").alias("kind"),
            F.col("concept").alias("subject"),
            F.concat(
                quoted,
                F.lit(" appears in only 1 paper in this corpus -- limited cross-paper validation."),
            ).alias("detail"),
        )
    )


def unevaluated(knowledge: DataFrame) -> DataFrame:
    """Methods of papers without any dataset; row-local."""
    return (
        knowledge.where(F.size(or_empty(F.col("datasets"))) == 0)
        .select("paper_title", F.explode("methods").alias("method"))
        .select(
            F.lit("unevaluated_method").alias("kind"),
            F.col("method").alias("subject"),
            F.concat(
                F.lit("'"), F.col("method"), F.lit("' (from '"), F.col("paper_title"),
                F.lit("') has no recognized dataset evaluation in the extracted text."),
            ).alias("detail"),
        )
    )


def gaps(knowledge: DataFrame, paper_concepts: DataFrame) -> DataFrame:
    return underexplored(paper_concepts).unionByName(unevaluated(knowledge))


def missing_citations(paper_concepts: DataFrame, cites: DataFrame) -> DataFrame:
    """Papers using a dataset that an earlier paper used first, without citing it.

    paper_concepts as in the knowledge plan; cites: (paper_title, paper_id,
    cited_title). The first user is a min_by combined map-side; a dataset in a
    third of all rows meets one origin row, which AQE can split freely.
    """
    used = paper_concepts.where(F.col("kind") == "dataset").select(
        "paper_id", "paper_title", "ord", "concept"
    )
    origin = used.groupBy("concept").agg(
        F.min_by("paper_title", F.struct("ord", "paper_id")).alias("origin")
    )
    # the knowledge list may name a dataset twice: each mention is reported
    reuse = used.join(origin, "concept").where(
        (F.col("origin") != F.col("paper_title")) & (F.col("origin") != "")
    )
    cited = cites.select("paper_id", F.col("cited_title").alias("origin")).distinct()
    return reuse.join(cited, ["paper_id", "origin"], "left_anti").select(
        "paper_id",
        F.col("paper_title").alias("citing_paper_title"),
        "concept",
        F.lit("dataset").alias("concept_type"),
        F.col("origin").alias("likely_source_paper"),
        F.concat(
            F.lit("Uses '"), F.col("concept"), F.lit("', which '"), F.col("origin"),
            F.lit("' evaluates on first in this corpus, but does not cite it."),
        ).alias("reason"),
    )
