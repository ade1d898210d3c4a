"""Quantified claims: figures per dataset, contradictions, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.functions.text import first_percentage, or_empty
from folioscope.operators.ordering import numbered

# Default thresholds.
MIN_SPREAD, MIN_POINTS = 5.0, 2

PAPERS_PER_BLOCK = 65536


def claim_figures(knowledge: DataFrame) -> DataFrame:
    """First percentage of each claim, attached to the paper's own datasets the
    claim mentions. Row-local: both lists sit in the paper's row."""
    claims = knowledge.select(
        "paper_id",
        "paper_title",
        "year",
        "ord",
        or_empty(F.col("datasets")).alias("datasets"),
        F.posexplode(or_empty(F.col("claims"))).alias("claim_no", "claim"),
    ).withColumn("value", first_percentage(F.col("claim")))
    return (
        claims.where(F.col("value").isNotNull())
        .select("*", F.posexplode("datasets").alias("dataset_no", "dataset"))
        .where(F.contains(F.lower("claim"), F.lower("dataset")))
        .select(
            "paper_id", "paper_title", "year", "ord", "claim_no", "dataset_no", "dataset",
            "value", "claim",
        )
    )


def contradictions(
    figures: DataFrame, min_spread: float = MIN_SPREAD, distinct_papers: bool = False
) -> DataFrame:
    """Datasets whose figures lie at least ``min_spread`` apart: (dataset,
    figures, spread). ``distinct_papers`` also asks for two different papers."""
    spread = F.max("value") - F.min("value")
    grouped = figures.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("figures"),
        spread.alias("raw"),
        (F.min("paper_title") != F.max("paper_title")).alias("two_papers"),
    )
    kept = (F.col("figures") >= 2) & (F.col("raw") >= min_spread)
    if distinct_papers:
        kept = kept & F.col("two_papers")
    return grouped.where(kept).select("dataset", "figures", F.round("raw", 2).alias("spread"))


def contradiction_figures(figures: DataFrame, found: DataFrame) -> DataFrame:
    """The figures behind each contradiction as rows, never as one list per
    dataset: a benchmark used everywhere would not fit in one."""
    return figures.join(found.select("dataset", "spread"), "dataset")


def timelines(figures: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Per dataset with enough dated figures: first and last value by year."""
    at = F.struct("year", "ord", "claim_no", "dataset_no")
    return (
        figures.where(F.coalesce(F.col("year"), F.lit(0)) != 0)
        .groupBy("dataset")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.min("year").alias("first_year"),
            F.max("year").alias("last_year"),
            F.min_by("value", at).alias("first_value"),
            F.max_by("value", at).alias("last_value"),
        )
        .where(F.col("points") >= min_points)
        .withColumn("improved", F.col("last_value") > F.col("first_value"))
    )


def timeline_points(figures: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Year-ordered points of each timeline, numbered from 0.

    A dataset may hold a large share of all figures, so the numbering runs in
    blocks of (year, paper range) instead of one sorted partition per dataset.
    """
    dated = figures.where(F.coalesce(F.col("year"), F.lit(0)) != 0)
    enough = (
        dated.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points)
    )
    return numbered(
        dated.join(enough.select("dataset"), "dataset", "left_semi"),
        ["dataset"],
        ["year", "ord", "claim_no", "dataset_no"],
        F.struct(F.col("year"), F.floor(F.col("ord") / PAPERS_PER_BLOCK)),
        "point",
    )
