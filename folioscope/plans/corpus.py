"""The whole corpus run: pages to facts to graph to analyses.

The tables that many later steps read are written to Parquet in ``workdir`` (a
folder all executors share), so a lost executor re-reads a file and the analyses
do not repeat the text work. Everything after ``knowledge`` is lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.operators.analysis import (
    knowledge_summary,
    paper_analysis,
    paper_cites,
    paper_concepts,
)
from folioscope.operators.citations import citation_match
from folioscope.operators.extraction import entity_rows, extract_facts, relationship_rows
from folioscope.operators.figures import claim_figures, contradictions, timelines
from folioscope.operators.gaps import gaps, missing_citations
from folioscope.operators.graph import citation_edges, resolve_edges, resolve_entities
from folioscope.operators.novelty import novelty
from folioscope.operators.overlap import recommend, shared_concepts, with_empty
from folioscope.operators.report import review_lines, run_totals
from folioscope.operators.structure import segment_sections, split_references
from folioscope.sources.responses import coalesce_extractions, parse_responses, parsed_papers


def run_corpus(
    spark: SparkSession,
    papers: DataFrame,
    pages: DataFrame,
    workdir: str,
    query: str = "",
    responses: DataFrame | None = None,
    **extraction_options,
) -> dict[str, DataFrame]:
    """papers: (paper_id, title, abstract, published_at, ord); pages: (paper_id,
    page_no, text); responses: (paper_id, response). Returns every stage by name."""

    def kept(name: str, df: DataFrame) -> DataFrame:
        path = f"{workdir}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    sections = kept("sections", segment_sections(pages))
    references = kept("references", split_references(sections))

    facts = extract_facts(sections, papers, **extraction_options)
    if responses is not None:
        asked = responses.join(
            papers.select("paper_id", "title", F.col("ord").alias("paper_ord")), "paper_id"
        )
        facts = coalesce_extractions(parse_responses(asked), facts, parsed_papers(responses))
    facts = kept("facts", facts)
    raw_entities, raw_relationships = entity_rows(facts), relationship_rows(facts)

    entities = kept("entities", resolve_entities(raw_entities, papers))
    matches = kept("matches", citation_match(references, papers))
    edge_columns = ["source_entity_id", "target_entity_id", "relationship_type", "evidence", "confidence"]
    edges = resolve_edges(raw_relationships, raw_entities, papers).select("paper_id", *edge_columns)
    relationships = kept(
        "relationships",
        edges.unionByName(citation_edges(matches, papers).select("paper_id", *edge_columns)),
    )
    knowledge = kept(
        "knowledge",
        knowledge_summary(papers, raw_entities, raw_relationships, matches, entities),
    )

    concepts = paper_concepts(knowledge)
    figures = claim_figures(knowledge)
    recommended = recommend(concepts)
    return {
        "sections": sections,
        "references": references,
        "entities": entities,
        "relationships": relationships,
        "knowledge": knowledge,
        "contradictions": contradictions(figures).orderBy(F.col("spread").desc(), "dataset"),
        "gaps": gaps(knowledge, concepts),
        "novelty": novelty(concepts),
        "timelines": timelines(figures).orderBy("dataset"),
        "analyses": paper_analysis(knowledge),
        "missing_citations": missing_citations(concepts, paper_cites(knowledge)),
        "recommendations": with_empty(shared_concepts(recommended, concepts), knowledge),
        "review": review_lines(query, knowledge),
        "totals": run_totals(
            discovered=papers,
            ingested=sections.select("paper_id").distinct(),
            entities=raw_entities,
            relationships=relationships,
        ),
    }
