"""One catalog shape over all sources, ingest planning, upsert, authors."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from folioscope.functions.text import name_key, strip

COLUMNS = [
    "source", "source_id", "arxiv_id", "title", "abstract", "authors", "year", "venue",
    "citation_count", "pdf_url",
]


class DiscoveryError(RuntimeError):
    """Every requested source failed."""


class SourceLeftOut(UserWarning):
    """A source could not be opened, so the union lacks it."""


def from_feed(entries: DataFrame) -> DataFrame:
    return entries.select(
        F.lit("arxiv").alias("source"),
        F.col("arxiv_id").alias("source_id"),
        "arxiv_id",
        "title",
        "abstract",
        "authors",
        F.year("published_at").alias("year"),
        F.lit(None).cast("string").alias("venue"),
        F.lit(None).cast("int").alias("citation_count"),
        "pdf_url",
    )


def from_search(entries: DataFrame) -> DataFrame:
    return entries.select(
        F.lit("semantic_scholar").alias("source"), "source_id", "arxiv_id", "title", "abstract",
        "authors", "year", "venue", "citation_count", "pdf_url",
    )


def unify(
    loaders: dict[str, Callable[[], DataFrame]], sources: list[str] | None = None
) -> DataFrame:
    """Union of the requested sources in catalog shape, without cross-source
    dedupe. A source that cannot be opened is left out with a warning that names
    it and its error, unless none can. A source that fails later fails the job."""
    frames, errors = [], []
    for name, load in loaders.items():
        if sources is not None and name not in sources:
            continue
        try:
            frames.append(load().select(*COLUMNS))
        except (AnalysisException, OSError) as problem:
            errors.append(f"{name}: {problem}")
            warnings.warn(f"source left out: {errors[-1]}", SourceLeftOut, stacklevel=2)
    if not frames:
        raise DiscoveryError("; ".join(errors) or "no source requested")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def plan_ingest(requested: DataFrame, papers: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Requested papers that are not completed yet."""
    done = papers.where(F.col("extraction_status") == "completed").select(key)
    return requested.join(done, key, "left_anti")


def upsert_papers(
    papers: DataFrame, incoming: DataFrame, key: str = "arxiv_id", order: list[str] | None = None
) -> DataFrame:
    """Paper table after an ingest run: completed papers stay as they are, others
    take the incoming row; of several, the last by ``order`` and then by all columns."""
    rank = F.when(F.col("extraction_status") == "completed", 2).otherwise(0)
    columns = papers.columns
    both = papers.withColumn("rank", rank).unionByName(
        incoming.select(*columns).withColumn("rank", F.lit(1))
    )
    return (
        both.groupBy(key)
        .agg(F.max_by(F.struct(*columns), F.struct("rank", *(order or []), *columns)).alias("row"))
        .select("row.*")
    )


def resolve_authors(mentions: DataFrame, order: list[str]) -> DataFrame:
    """One author per trimmed lower name: (normalized_name, name); first spelling kept."""
    return mentions.groupBy(name_key(F.col("name")).alias("normalized_name")).agg(
        F.min_by(strip(F.col("name")), F.struct(*order)).alias("name")
    )
