"""Listings, paper detail, review text, run totals and display cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.functions.text import join_first, or_empty, prefix

# Display limits.
PAGE_SIZE, PAGE_MAX = 50, 200
CLAIMS_SHOWN, SECTION_SHOWN, AUTHORS_ON_CARD, AUTHORS_IN_SEARCH = 3, 2000, 3, 4


def list_papers(papers: DataFrame, limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    """Newest first; a bounded page, planned as a top-k."""
    if not 1 <= limit <= PAGE_MAX or offset < 0:
        raise ValueError("limit must be 1..200 and offset not negative")
    return papers.orderBy(F.col("created_at").desc(), "paper_id").offset(offset).limit(limit)


def ordered_authors(paper_authors: DataFrame, authors: DataFrame) -> DataFrame:
    """(paper_id, authors): names in author order."""
    return (
        paper_authors.join(authors, "author_id")
        .groupBy("paper_id")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("author_order", "name"))), lambda a: a["name"]
            ).alias("authors")
        )
    )


def paper_detail(
    papers: DataFrame,
    paper_authors: DataFrame,
    authors: DataFrame,
    sections: DataFrame,
    references: DataFrame,
) -> DataFrame:
    """Papers with ordered authors, sections and references as nested lists, empty
    where a paper has none. Each child is aggregated before the join, so children
    never multiply each other."""
    nested_sections = sections.groupBy("paper_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("order_index", "heading", "section_type", "page_start", "page_end", "content")
            )
        ).alias("sections")
    )
    nested_references = references.groupBy("paper_id").agg(
        F.array_sort(F.collect_list(F.struct("order_index", "raw_text", "parsed_year"))).alias("references")
    )
    return (
        papers.join(ordered_authors(paper_authors, authors), "paper_id", "left")
        .join(nested_sections, "paper_id", "left")
        .join(nested_references, "paper_id", "left")
        .withColumns({c: F.coalesce(c, F.array()) for c in ("authors", "sections", "references")})
    )


def paper_cards(catalog: DataFrame, shown: int = AUTHORS_ON_CARD) -> DataFrame:
    """Author line as on a card: the first names, then 'et al.'."""
    return catalog.withColumn("author_line", join_first(or_empty(F.col("authors")), shown))


def section_previews(sections: DataFrame, shown: int = SECTION_SHOWN) -> DataFrame:
    """Sections as displayed: references left out, long text cut."""
    return sections.where(F.col("section_type") != "references").withColumn(
        "preview", prefix(F.col("content"), shown)
    )


def status_funnel(papers: DataFrame) -> DataFrame:
    return papers.groupBy("extraction_status").agg(F.count(F.lit(1)).alias("papers"))


def run_totals(**stages: DataFrame) -> DataFrame:
    """(stage, rows) per named stage; each count is one combined aggregate."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows")
        for name, df in stages.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def review_lines(query: str, knowledge: DataFrame) -> DataFrame:
    """The review as lines: (block, ord, item, line).

    Sorting by these columns gives the text. Blocks: 0 title and head count, 1
    methods, 2 datasets, 3 papers. Names sort by ``item_key``; no global
    numbering is needed, so no step sees all lines at once.
    """
    total = knowledge.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.size(or_empty(F.col("methods"))) > 0).alias("with_methods"),
        F.count_if(F.size(or_empty(F.col("datasets"))) > 0).alias("with_datasets"),
    )
    counted = F.concat(
        F.lit("This review covers "), F.col("n").cast("string"),
        F.lit(f' paper(s) discovered and analyzed for the query "{query}".'),
    )
    nothing = F.lit(
        "No papers were successfully ingested and extracted for this query, "
        "so no review could be generated."
    )

    def fixed(block: int, *lines) -> list:
        return [
            F.struct(F.lit(block).alias("block"), F.lit(i).alias("item"), line.alias("line"))
            for i, line in enumerate(lines)
        ]

    def captioned(when, block: int, heading: str):
        return F.when(when, F.array(*fixed(block, F.lit(""), F.lit(heading)))).otherwise(F.array())

    some = F.col("n") > 0
    captions = F.concat(
        F.array(
            *fixed(0, F.lit(f"# Literature Review: {query}"), F.lit(""), F.when(some, counted).otherwise(nothing))
        ),
        captioned(F.col("with_methods") > 0, 1, "## Methods Identified"),
        captioned(F.col("with_datasets") > 0, 2, "## Datasets Used"),
        captioned(some, 3, "## Per-Paper Summary"),
    )
    head = total.select(F.explode(captions).alias("c")).select(
        F.col("c.block").alias("block"), F.lit(-1).cast("bigint").alias("ord"),
        F.lit("").alias("item_key"), F.col("c.item").alias("item"), F.col("c.line").alias("line"),
    )
    tagged = F.concat(
        F.transform(or_empty(F.col("methods")), lambda m: F.struct(F.lit(1).alias("block"), m.alias("name"))),
        F.transform(or_empty(F.col("datasets")), lambda d: F.struct(F.lit(2).alias("block"), d.alias("name"))),
    )
    names = knowledge.select(F.explode(tagged).alias("t")).select("t.block", "t.name").distinct()
    listed = names.select(
        "block", F.lit(0).cast("bigint").alias("ord"), F.col("name").alias("item_key"),
        F.lit(0).alias("item"), F.concat(F.lit("- "), F.col("name")).alias("line"),
    )
    return head.unionByName(listed).unionByName(_paper_lines(knowledge))


def _paper_lines(knowledge: DataFrame) -> DataFrame:
    listed = lambda label, c: F.when(
        F.size(or_empty(F.col(c))) > 0,
        F.concat(F.lit(f"**{label}:** "), F.array_join(c, ", ")),
    )
    claims = F.slice(or_empty(F.col("claims")), 1, CLAIMS_SHOWN)
    lines = F.array_compact(
        F.concat(
            F.array(
                F.concat(F.lit("### "), F.col("paper_title")),
                listed("Proposes", "methods"),
                listed("Evaluated on", "datasets"),
                F.when(F.size(claims) > 0, F.lit("**Key claims:**")),
            ),
            F.transform(claims, lambda c: F.concat(F.lit("- "), c)),
            F.array(F.lit("")),
        )
    )
    return knowledge.select(
        F.lit(3).alias("block"),
        F.col("ord"),
        F.col("paper_id").cast("string").alias("item_key"),
        F.posexplode(lines).alias("item", "line"),
    )


def write_review(lines: DataFrame, path: str) -> None:
    """Review as text files whose order is the line order (range-partitioned sort)."""
    lines.orderBy("block", "ord", "item_key", "item").select("line").write.mode("overwrite").text(path)
