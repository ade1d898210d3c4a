"""Paper feeds as files: Atom responses and search-response JSON.

One row is one response document (a result page of the feed), parsed by the
built-in XML and JSON functions against declared schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions.text import (
    arxiv_base_id,
    arxiv_id,
    clean_text,
    or_empty,
    parse_utc,
    strip,
)
from folioscope.schemas import SEARCH_ITEM

FEED = (
    "entry ARRAY<STRUCT<id: STRING, updated: STRING, published: STRING, title: STRING, "
    "summary: STRING, author: ARRAY<STRUCT<name: STRING>>, "
    "primary_category: STRUCT<_term: STRING>, category: ARRAY<STRUCT<_term: STRING>>, "
    "link: ARRAY<STRUCT<_href: STRING, _title: STRING, _type: STRING>>>>"
)

# Fixed value: where a feed paper's PDF is when no link says so.
PDF_URL = "https://arxiv.org/pdf/"


def parse_feeds(documents: DataFrame, xml_col: str) -> DataFrame:
    """Atom documents to entries; malformed XML fails the job."""
    options = {"mode": "FAILFAST", "ignoreNamespace": "true"}
    entries = documents.withColumn(
        "e", F.explode(F.from_xml(F.col(xml_col), FEED, options)["entry"])
    ).where(F.coalesce(F.col("e.id"), F.lit("")) != "")
    pdf = F.filter(
        or_empty(F.col("e.link"), "struct<_href:string,_title:string,_type:string>"),
        lambda l: F.coalesce(l["_title"] == "pdf", F.lit(False))
        | F.coalesce(l["_type"] == "application/pdf", F.lit(False)),
    )
    names = F.filter(F.col("e.author.name"), lambda n: F.coalesce(n, F.lit("")) != "")
    terms = F.filter(F.col("e.category._term"), lambda t: F.coalesce(t, F.lit("")) != "")
    return entries.select(
        *[c for c in documents.columns if c != xml_col],
        arxiv_id(F.col("e.id")).alias("arxiv_id"),
        clean_text(F.col("e.title")).alias("title"),
        clean_text(F.col("e.summary")).alias("abstract"),
        or_empty(F.transform(names, clean_text)).alias("authors"),
        parse_utc(F.col("e.published")).alias("published_at"),
        parse_utc(F.col("e.updated")).alias("updated_at"),
        F.col("e.primary_category._term").alias("primary_category"),
        or_empty(terms).alias("categories"),
        F.coalesce(F.get(pdf, F.lit(0))["_href"], F.concat(F.lit(PDF_URL), arxiv_id(F.col("e.id")))).alias(
            "pdf_url"
        ),
    ).withColumn("arxiv_base_id", arxiv_base_id(F.col("arxiv_id")))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    return parse_feeds(spark.read.text(path, wholetext=True), "value")


def parse_search_payloads(documents: DataFrame, json_col: str) -> DataFrame:
    """Search responses to entries. A body without a 'data' list fails the job;
    single records without an id, or that are not objects, are skipped."""
    data = F.get_json_object(F.col(json_col), "$.data")
    checked = (
        F.when(data.isNull(), F.raise_error(F.lit("search response has no 'data' field")))
        .when(~data.startswith("["), F.raise_error(F.lit("'data' of a search response is not a list")))
        .otherwise(data)
    )
    # column pruning must not drop the check, so it feeds the explode
    items = documents.withColumn("item", F.explode(F.from_json(checked, "ARRAY<STRING>")))
    entries = items.withColumn("e", F.from_json("item", SEARCH_ITEM)).where(
        F.coalesce(F.col("e.paperId"), F.lit("")) != ""
    )
    names = F.filter(F.col("e.authors.name"), lambda n: F.coalesce(n, F.lit("")) != "")
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    external = lambda key: F.try_element_at("e.externalIds", F.lit(key))
    return entries.select(
        *[c for c in documents.columns if c != json_col],
        F.col("e.paperId").alias("source_id"),
        text("e.title").alias("title"),
        text("e.abstract").alias("abstract"),
        or_empty(F.transform(names, strip)).alias("authors"),
        F.col("e.year").alias("year"),
        F.when(F.col("e.venue") != "", F.col("e.venue")).alias("venue"),
        F.col("e.citationCount").alias("citation_count"),
        external("ArXiv").alias("arxiv_id"),
        external("DOI").alias("doi"),
        F.col("e.openAccessPdf.url").alias("pdf_url"),
        F.when(F.coalesce(F.col("e.year"), F.lit(0)) != 0, F.make_date("e.year", F.lit(1), F.lit(1))).alias(
            "published_on"
        ),
    )


def read_search_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_search_payloads(spark.read.text(path, wholetext=True), "value")
