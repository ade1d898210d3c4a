"""Declared schemas. No source relies on inference."""

from __future__ import annotations

CATALOG = (
    "source STRING, source_id STRING, arxiv_id STRING, title STRING, abstract STRING, "
    "authors ARRAY<STRING>, year INT, venue STRING, citation_count INT, pdf_url STRING"
)

PAPERS = (
    "paper_id STRING, arxiv_id STRING, doi STRING, title STRING, abstract STRING, "
    "published_at TIMESTAMP, updated_at TIMESTAMP, primary_category STRING, "
    "categories ARRAY<STRING>, pdf_url STRING, source STRING, full_text STRING, "
    "extraction_status STRING, extraction_error STRING, num_pages INT, "
    "created_at TIMESTAMP, ord BIGINT"
)

PAPER_PAGES = "paper_id STRING, page_no INT, text STRING"

SECTIONS = (
    "paper_id STRING, order_index INT, heading STRING, section_type STRING, "
    "page_start INT, page_end INT, content STRING"
)

REFERENCES = (
    "paper_id STRING, reference_id STRING, order_index INT, raw_text STRING, parsed_year INT"
)

RAW_ENTITIES = (
    "paper_id STRING, paper_ord BIGINT, ord INT, entity_type STRING, name STRING, "
    "description STRING, extraction_method STRING, confidence DOUBLE"
)

RAW_RELATIONSHIPS = (
    "paper_id STRING, ord INT, source_name STRING, target_name STRING, "
    "relationship_type STRING, evidence STRING, confidence DOUBLE"
)

ENTITIES = (
    "entity_id STRING, entity_type STRING, name STRING, normalized_name STRING, "
    "description STRING, source_paper_id STRING, extraction_method STRING, confidence DOUBLE"
)

RELATIONSHIPS = (
    "source_entity_id STRING, target_entity_id STRING, relationship_type STRING, "
    "evidence STRING, confidence DOUBLE"
)

KNOWLEDGE = (
    "paper_id STRING, paper_title STRING, year INT, ord BIGINT, methods ARRAY<STRING>, "
    "datasets ARRAY<STRING>, claims ARRAY<STRING>, cites ARRAY<STRING>"
)

REQUESTS = "ts TIMESTAMP, method STRING, path STRING, status INT, duration DOUBLE"

# Feed entry as the XML source sees it with rowTag=entry.
ATOM_ENTRY = (
    "id STRING, updated STRING, published STRING, title STRING, summary STRING, "
    "author ARRAY<STRUCT<name: STRING>>, "
    "`arxiv:primary_category` STRUCT<_term: STRING>, "
    "category ARRAY<STRUCT<_term: STRING>>, "
    "link ARRAY<STRUCT<_href: STRING, _title: STRING, _type: STRING>>"
)

# Search response body.
SEARCH_ITEM = (
    "STRUCT<paperId: STRING, title: STRING, abstract: STRING, year: INT, venue: STRING, "
    "citationCount: INT, authors: ARRAY<STRUCT<name: STRING>>, "
    "externalIds: MAP<STRING, STRING>, openAccessPdf: STRUCT<url: STRING>>"
)

# Extraction response body.
RESPONSE = (
    "methods ARRAY<STRUCT<name: STRING, description: STRING>>, "
    "datasets ARRAY<STRUCT<name: STRING>>, metrics ARRAY<STRUCT<name: STRING>>, "
    "claims ARRAY<STRUCT<description: STRING, evidence: STRING>>"
)

# The closed vocabularies a graph export accepts.
ENTITY_TYPES = [
    "paper", "author", "method", "dataset", "task", "metric", "benchmark", "claim", "concept",
]
RELATIONSHIP_TYPES = [
    "cites", "proposes", "uses_dataset", "evaluated_on", "improves_on", "contradicts",
    "compares_to", "authored_by", "mentions",
]
