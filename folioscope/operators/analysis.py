"""Knowledge records per paper and the per-paper analysis built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.functions.text import capitalize_first, or_empty
from folioscope.operators.novelty import novelty
from folioscope.operators.overlap import impact


def paper_concepts(knowledge: DataFrame) -> DataFrame:
    """Long form of methods and datasets: one row per list element."""
    tagged = F.concat(
        F.transform(or_empty(F.col("methods")), lambda m: F.struct(F.lit("method").alias("kind"), m.alias("concept"))),
        F.transform(or_empty(F.col("datasets")), lambda d: F.struct(F.lit("dataset").alias("kind"), d.alias("concept"))),
    )
    return knowledge.select(
        "paper_id", "paper_title", "year", "ord", F.explode(tagged).alias("c")
    ).select("paper_id", "paper_title", "year", "ord", "c.kind", "c.concept")


def paper_cites(knowledge: DataFrame) -> DataFrame:
    return knowledge.select(
        "paper_id", "paper_title", F.explode(or_empty(F.col("cites"))).alias("cited_title")
    )


def knowledge_summary(
    papers: DataFrame,
    raw_entities: DataFrame,
    raw_relationships: DataFrame,
    cites: DataFrame | None = None,
    entities: DataFrame | None = None,
) -> DataFrame:
    """One record per paper: names by type, claim texts, cited titles, counts.

    ``entities`` supplies the resolved spelling of a name where given. cites:
    (paper_id, reference_id, cited_title), one row per citation edge, listed by
    ``reference_order`` where there is such a column.
    """
    named = raw_entities
    if entities is not None:
        from folioscope.operators.graph import entity_id

        resolved = entities.select("entity_id", F.col("name").alias("resolved"))
        named = (
            raw_entities.withColumn("entity_id", entity_id(F.col("entity_type"), F.col("name")))
            .join(resolved, "entity_id", "left")
            .withColumn("name", F.coalesce("resolved", "name"))
            .drop("resolved", "entity_id")
        )

    def names(kind: str, column: str):
        kept = F.when(
            (F.col("entity_type") == kind) & (F.coalesce(F.col(column), F.lit("")) != ""),
            F.struct(F.col("ord"), F.col(column).alias("v")),
        )
        return F.transform(F.array_sort(F.collect_list(kept)), lambda e: e["v"])

    facts = named.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("entities_created"),
        names("method", "name").alias("methods"),
        names("dataset", "name").alias("datasets"),
        names("claim", "description").alias("claims"),
        F.max("extraction_method").alias("method_used"),
    )
    edges = raw_relationships.groupBy("paper_id").agg(F.count(F.lit(1)).alias("edges"))
    out = (
        papers.select(
            "paper_id", F.col("title").alias("paper_title"), F.year("published_at").alias("year"), "ord"
        )
        .join(facts, "paper_id", "left")
        .join(edges, "paper_id", "left")
    )
    if cites is None:
        out = out.withColumn("cites", F.array().cast("array<string>")).withColumn("cited", F.lit(0))
    else:
        by = [c for c in cites.columns if c == "reference_order"]
        listed = cites.groupBy("paper_id").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(*by, "reference_id", "cited_title"))),
                lambda e: e["cited_title"],
            ).alias("cites"),
            F.count(F.lit(1)).alias("cited"),
        )
        out = out.join(listed, "paper_id", "left")
    return out.select(
        "paper_id",
        "paper_title",
        "year",
        "ord",
        F.coalesce("entities_created", F.lit(0)).alias("entities_created"),
        (F.coalesce("edges", F.lit(0)) + F.coalesce("cited", F.lit(0))).alias("relationships_created"),
        F.coalesce("method_used", F.lit("heuristic")).alias("method_used"),
        or_empty(F.col("methods")).alias("methods"),
        or_empty(F.col("datasets")).alias("datasets"),
        or_empty(F.col("claims")).alias("claims"),
        or_empty(F.col("cites")).alias("cites"),
    )


def paper_analysis(knowledge: DataFrame, **overlap_options) -> DataFrame:
    """Novelty, impact, evidence density, contributions and summary per paper.

    Density, contributions and the summary are computed inside the row; novelty
    joins by title and impact by paper.
    """
    concepts = paper_concepts(knowledge)
    by_title = (
        novelty(concepts)
        .groupBy("paper_title")
        .agg(
            F.round(
                F.sum(F.col("novelty_score") * F.col("mentions")) / F.sum("mentions"), 2
            ).alias("novelty_score")
        )
    )
    scored = impact(concepts, knowledge.select("paper_id", "paper_title"), **overlap_options)
    base = knowledge.select(
        "paper_id",
        "paper_title",
        F.array_sort(F.array_distinct(or_empty(F.col("methods")))).alias("m"),
        F.array_sort(F.array_distinct(or_empty(F.col("datasets")))).alias("d"),
        F.size(or_empty(F.col("claims"))).alias("n_claims"),
    )
    parts = F.concat_ws(
        "; ",
        F.when(F.size("m") > 0, F.concat(F.lit("proposes "), F.array_join("m", ", "))),
        F.when(F.size("d") > 0, F.concat(F.lit("evaluated on "), F.array_join("d", ", "))),
    )
    count = F.col("n_claims").cast("string")
    summary = F.when(
        parts != "",
        F.concat(capitalize_first(parts), F.lit("; "), count, F.lit(" evidence-backed claim(s) extracted.")),
    ).otherwise(
        F.concat(
            count,
            F.lit(" evidence-backed claim(s) extracted; no methods or datasets recognized in the text."),
        )
    )
    density = F.round(F.col("n_claims") / F.greatest(F.size("m") + F.size("d"), F.lit(1)), 2)
    # texts are made after the joins, which move the names alone
    return base.join(by_title, "paper_title", "left").join(scored, "paper_id").select(
        "paper_id", "paper_title", "novelty_score", "impact_score", density.alias("evidence_density"),
        F.col("m").alias("key_contributions"), summary.alias("summary"),
    )
