"""Entity resolution, edge resolution, citation edges, subgraphs, export shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.text import name_key, stable_id, strip
from folioscope.schemas import ENTITY_TYPES, RELATIONSHIP_TYPES


def entity_id(entity_type: Column, name: Column) -> Column:
    """An entity is its type and normalised name, so its id needs no lookup."""
    return stable_id(entity_type, name_key(name))


def paper_entity_id(title: Column) -> Column:
    return entity_id(F.lit("paper"), title)


def paper_nodes(papers: DataFrame) -> DataFrame:
    """Every paper as a raw entity that comes before the facts taken from it."""
    return papers.select(
        "paper_id",
        F.col("ord").alias("paper_ord"),
        F.lit(-1).alias("ord"),
        F.lit("paper").alias("entity_type"),
        F.col("title").alias("name"),
        F.col("abstract").alias("description"),
        F.lit("direct").alias("extraction_method"),
        F.lit(1.0).alias("confidence"),
    )


def resolve_entities(
    raw_entities: DataFrame, papers: DataFrame | None = None, existing: DataFrame | None = None
) -> DataFrame:
    """One entity per (type, trimmed lower name); the first mention supplies its
    attributes. Claims and papers keep their source paper. With ``existing``,
    only entities not yet in that table are returned.

    min_by is combined map-side, so a name held by a third of all rows ships one
    row per task.
    """
    raw = raw_entities
    if papers is not None:
        raw = raw.unionByName(paper_nodes(papers))
    mention = F.struct(
        strip(F.col("name")).alias("name"),
        "description",
        F.when(F.col("entity_type").isin("paper", "claim"), F.col("paper_id")).alias(
            "source_paper_id"
        ),
        "extraction_method",
        "confidence",
    )
    first = (
        raw.groupBy("entity_type", name_key(F.col("name")).alias("normalized_name"))
        .agg(F.min_by(mention, F.struct("paper_ord", "ord")).alias("first"))
        .select(
            stable_id(F.col("entity_type"), F.col("normalized_name")).alias("entity_id"),
            "entity_type",
            F.col("first.name").alias("name"),
            "normalized_name",
            F.col("first.description").alias("description"),
            F.col("first.source_paper_id").alias("source_paper_id"),
            F.col("first.extraction_method").alias("extraction_method"),
            F.col("first.confidence").alias("confidence"),
        )
    )
    if existing is None:
        return first
    return first.join(existing.select("entity_id"), "entity_id", "left_anti")


def resolve_edges(
    raw_relationships: DataFrame, raw_entities: DataFrame, papers: DataFrame
) -> DataFrame:
    """Names to entity ids inside each paper; an edge with an unknown end is dropped.

    Where one paper uses a name twice the later mention decides. Ids come from
    type and name, so the entity table is not joined at all.
    """
    names = (
        raw_entities.select("paper_id", "ord", "entity_type", "name")
        .unionByName(paper_nodes(papers).select("paper_id", "ord", "entity_type", "name"))
        .groupBy("paper_id", name_key(F.col("name")).alias("key"))
        .agg(F.max_by(entity_id(F.col("entity_type"), F.col("name")), F.col("ord")).alias("id"))
    )
    source = names.select("paper_id", F.col("key").alias("source_key"), F.col("id").alias("source_entity_id"))
    target = names.select("paper_id", F.col("key").alias("target_key"), F.col("id").alias("target_entity_id"))
    return (
        raw_relationships.withColumn("source_key", name_key(F.col("source_name")))
        .withColumn("target_key", name_key(F.col("target_name")))
        .join(target, ["paper_id", "target_key"])
        .join(source, ["paper_id", "source_key"])
        .select(
            "paper_id", "ord", "source_entity_id", "target_entity_id", "relationship_type",
            "evidence", "confidence",
        )
    )


def citation_edges(matches: DataFrame, papers: DataFrame) -> DataFrame:
    """One 'cites' edge per citation match, from the citing to the cited paper node."""
    titles = papers.select("paper_id", "title")
    return matches.join(titles, "paper_id").select(
        "paper_id",
        "reference_id",
        paper_entity_id(F.col("title")).alias("source_entity_id"),
        paper_entity_id(F.col("cited_title")).alias("target_entity_id"),
        F.lit("cites").alias("relationship_type"),
        F.col("cited_title").alias("evidence"),
        F.col("match_confidence").alias("confidence"),
    )


def paper_subgraph(
    entities: DataFrame,
    relationships: DataFrame,
    papers: DataFrame,
    paper_ids: DataFrame,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """One-hop subgraph of each requested paper, as (nodes, edges) with paper_id.

    Seeds are the paper's own node and the entities it is the source of; edges
    touch a seed at either end (two equi joins, not an OR join). Every stored edge
    counts: equal ones stay as often as they are stored, also loops.
    ``strict`` leaves nodes at the seeds; otherwise both ends of every edge are in.
    """
    own = papers.join(paper_ids.select("paper_id").distinct(), "paper_id", "left_semi").select(
        "paper_id", paper_entity_id(F.col("title")).alias("entity_id")
    )
    sourced = entities.join(
        paper_ids.select("paper_id").distinct(),
        F.col("source_paper_id") == F.col("paper_id"),
    ).select("paper_id", "entity_id")
    known_own = own.join(entities.select("entity_id"), "entity_id", "left_semi").select(
        "paper_id", "entity_id"
    )
    seeds = sourced.unionByName(known_own).distinct()
    edge_cols = ["source_entity_id", "target_entity_id", "relationship_type", "evidence"]
    links = relationships.drop("paper_id")
    by_source = links.join(
        seeds.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id"
    )
    by_target = links.join(
        seeds.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id"
    )
    keep = ["paper_id", *links.columns]
    # an edge of two seeds of a paper was already found by its source
    sources = seeds.withColumnRenamed("entity_id", "source_entity_id")
    rest = by_target.join(sources, ["paper_id", "source_entity_id"], "left_anti")
    edges = by_source.select(*keep).unionByName(rest.select(*keep))
    wanted = seeds
    if not strict:
        wanted = (
            seeds.unionByName(edges.select("paper_id", F.col("source_entity_id").alias("entity_id")))
            .unionByName(edges.select("paper_id", F.col("target_entity_id").alias("entity_id")))
            .distinct()
        )
    nodes = wanted.join(entities, "entity_id").select(
        "paper_id", "entity_id", "entity_type", "name", "confidence"
    )
    return nodes, edges.select("paper_id", *edge_cols)


def nodes_by_type(nodes: DataFrame) -> DataFrame:
    """Node count per type, paper nodes left out."""
    return (
        nodes.where(F.col("entity_type") != "paper")
        .groupBy("entity_type")
        .agg(F.count(F.lit(1)).alias("nodes"))
    )


def _closed(df: DataFrame, column: str, accepted: list[str]) -> DataFrame:
    """Fail the job on a value outside the vocabulary, in the same pass."""
    value = F.col(column)
    return df.withColumn(
        column,
        F.when(value.isin(*accepted), value).otherwise(
            F.raise_error(F.concat(F.lit(f"unrecognised {column}: "), F.coalesce(value, F.lit("null"))))
        ),
    )


def merge_nodes(entities: DataFrame, order: str | None = None) -> DataFrame:
    """Nodes merged on (type, id), last write wins; of equal ones in ``order`` the
    greatest by all other columns."""
    rest = [c for c in entities.columns if c not in ("entity_type", "entity_id", order)]
    by = F.struct(*([order] if order else []), *rest)
    return (
        _closed(entities, "entity_type", ENTITY_TYPES)
        .groupBy("entity_type", "entity_id")
        .agg(F.max_by(F.struct(*rest), by).alias("last"))
        .select("entity_type", "entity_id", "last.*")
    )


def merge_edges(relationships: DataFrame, order: str) -> DataFrame:
    """Edges merged on (source, type, target); the last evidence and confidence
    stay, of equal ones in ``order`` the greatest."""
    return (
        _closed(relationships, "relationship_type", RELATIONSHIP_TYPES)
        .groupBy("source_entity_id", "relationship_type", "target_entity_id")
        .agg(F.max_by(F.struct("evidence", "confidence"), F.struct(order, "evidence", "confidence")).alias("last"))
        .select("source_entity_id", "relationship_type", "target_entity_id", "last.*")
    )


def export_graph(
    entities: DataFrame, relationships: DataFrame, path: str, edge_order: str, node_order: str | None = None
) -> None:
    """Write merged nodes and edges as Parquet, one folder per type. An edge
    whose ends are not both nodes is left out, as a property graph would."""
    nodes = merge_nodes(entities, node_order)
    ids = entities.select("entity_id")
    edges = (
        merge_edges(relationships, edge_order)
        .join(ids.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi")
        .join(ids.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi")
    )
    nodes.write.mode("overwrite").partitionBy("entity_type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relationship_type").parquet(f"{path}/edges")
