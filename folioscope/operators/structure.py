"""Paper structure: pages to sections, sections to references, pages to full text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.text import WS, first_year, split_lines, stable_id, strip
from folioscope.operators.ordering import numbered, running_total

# Section types in matching order and the heading line each accepts.
HEADINGS = [
    ("abstract", r"(?iu)^abstract$"),
    ("introduction", r"(?iu)^(\d+\.?\s*)?introduction$"),
    ("related_work", r"(?iu)^(\d+\.?\s*)?(related work|background|prior work)$"),
    ("methodology", r"(?iu)^(\d+\.?\s*)?(method(ology)?|approach|proposed method|model)$"),
    ("experiments", r"(?iu)^(\d+\.?\s*)?(experiments?|experimental setup|evaluation)$"),
    ("results", r"(?iu)^(\d+\.?\s*)?results?$"),
    ("discussion", r"(?iu)^(\d+\.?\s*)?discussion$"),
    ("limitations", r"(?iu)^(\d+\.?\s*)?limitations?$"),
    ("future_work", r"(?iu)^(\d+\.?\s*)?future work$"),
    ("conclusion", r"(?iu)^(\d+\.?\s*)?conclusions?$"),
    ("acknowledgments", r"(?iu)^acknowledg(e)?ments?$"),
    ("references", r"(?iu)^(references|bibliography)$"),
    ("appendix", r"(?iu)^(\d+\.?\s*)?appendix"),
]
MAX_HEADING = 60
LEADING_HEADING, LEADING_TYPE = "Preamble", "body"

REFERENCE_MARK = rf"(?:^|\n){WS}*(?:\[\d+\]|\d{{1,3}}\.){WS}+"

PAGES_PER_BLOCK = 256
SECTIONS_PER_BLOCK = 4096


def line_type(
    line: Column, headings: list[tuple[str, str]] = HEADINGS, max_len: int = MAX_HEADING
) -> Column:
    """Section type a line announces, or null for ordinary text."""
    bare = strip(line)
    choice = F.lit(None).cast("string")
    for name, pattern in reversed(headings):
        choice = F.when(bare.rlike(pattern), F.lit(name)).otherwise(choice)
    return F.when((F.length(bare) > 0) & (F.length(bare) <= max_len), choice)


def classify_lines(
    pages: DataFrame,
    headings: list[tuple[str, str]] = HEADINGS,
    max_len: int = MAX_HEADING,
) -> DataFrame:
    """Lines that are headings: (paper_id, page_no, line_no, line, section_type)."""
    lines = pages.select(
        "paper_id", "page_no", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line")
    )
    return lines.withColumn("section_type", line_type(F.col("line"), headings, max_len)).where(
        F.col("section_type").isNotNull()
    )


def _page_pieces(pages: DataFrame, headings: list[tuple[str, str]], max_len: int) -> DataFrame:
    """Cut each page at its headings inside the row: piece 0 continues the
    section of the page before, every later piece opens a section."""
    lined = pages.select("paper_id", "page_no", split_lines(F.col("text")).alias("lines"))
    typed = lined.withColumn(
        "types", F.transform("lines", lambda x: line_type(x, headings, max_len))
    )
    marked = typed.withColumn(
        "starts",
        F.array_compact(F.transform("types", lambda t, i: F.when(t.isNotNull(), i + 1))),
    )
    def piece(j: Column) -> Column:
        at = F.get("starts", j - 1)
        begin = F.coalesce(at, F.lit(0)) + 1
        count = F.coalesce(F.get("starts", j), F.size("lines") + 1) - begin
        return F.struct(
            j.alias("piece"),
            strip(F.get("lines", at - 1)).alias("heading"),
            F.get("types", at - 1).alias("section_type"),
            (count > 0).alias("has_text"),
            F.array_join(F.slice("lines", begin, F.greatest(count, F.lit(0))), "\n").alias("body"),
        )

    # the page's lines end here: only the pieces leave the explode
    pieces = F.transform(F.sequence(F.lit(0), F.size("starts")), piece)
    return marked.select("paper_id", "page_no", F.explode(pieces).alias("p")).select(
        "paper_id", "page_no", "p.*"
    )


def segment_sections(
    pages: DataFrame,
    headings: list[tuple[str, str]] = HEADINGS,
    max_len: int = MAX_HEADING,
) -> DataFrame:
    """Pages to sections, in reading order.

    Lines never leave their row: a page is cut in place and only its pieces are
    shuffled. Section numbers run across pages through block offsets, so a paper
    with very many pages is not sorted in one task. A section ends on the page
    of the next heading, also where that next section is empty and dropped.
    """
    pieces = _page_pieces(pages, headings, max_len)
    per_page = pages.select(
        "paper_id",
        "page_no",
        F.size(
            F.filter(split_lines(F.col("text")), lambda x: line_type(x, headings, max_len).isNotNull())
        ).alias("opened"),
    )
    opened = running_total(
        per_page,
        ["paper_id"],
        ["page_no"],
        F.floor(F.col("page_no") / PAGES_PER_BLOCK),
        F.col("opened"),
        "opened_before",
    ).drop("opened")
    placed = pieces.join(opened, ["paper_id", "page_no"]).withColumn(
        "section_no", F.col("opened_before") + F.col("piece")
    )
    # every heading also tells the section before it where it ends
    events = placed.withColumn(
        "role",
        F.explode(
            F.when(F.col("piece") > 0, F.array(F.lit(0), F.lit(-1))).otherwise(F.array(F.lit(0)))
        ),
    ).withColumn("section_no", F.col("section_no") + F.col("role"))
    own = F.col("role") == 0
    opener = own & (F.col("piece") > 0)
    grouped = events.groupBy("paper_id", "section_no").agg(
        F.max(F.when(opener, F.col("heading"))).alias("heading"),
        F.max(F.when(opener, F.col("section_type"))).alias("section_type"),
        F.max(F.when(opener, F.col("page_no"))).alias("page_start"),
        F.max(F.when(~own, F.col("page_no"))).alias("page_end"),
        F.collect_list(
            F.when(own & F.col("has_text"), F.struct("page_no", "piece", "body"))
        ).alias("bodies"),
    )
    extent = pages.groupBy("paper_id").agg(
        F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page")
    )
    content = strip(
        F.array_join(F.transform(F.array_sort("bodies"), lambda b: b["body"]), "\n")
    )
    filled = (
        grouped.join(extent, "paper_id")
        .select(
            "paper_id",
            "section_no",
            F.coalesce("heading", F.lit(LEADING_HEADING)).alias("heading"),
            F.coalesce("section_type", F.lit(LEADING_TYPE)).alias("section_type"),
            F.coalesce("page_start", "first_page").alias("page_start"),
            F.coalesce("page_end", "last_page").alias("page_end"),
            content.alias("content"),
        )
        .where(F.col("content") != "")
    )
    return numbered(
        filled,
        ["paper_id"],
        ["section_no"],
        F.floor(F.col("section_no") / SECTIONS_PER_BLOCK),
        "order_index",
    ).select(
        "paper_id",
        F.col("order_index").cast("int").alias("order_index"),
        "heading",
        "section_type",
        "page_start",
        "page_end",
        "content",
    )


def split_references(sections: DataFrame, mark: str = REFERENCE_MARK) -> DataFrame:
    """Entries of each paper's first references section, numbered from 0."""
    first = (
        sections.where(F.col("section_type") == "references")
        .groupBy("paper_id")
        .agg(F.min_by("content", "order_index").alias("content"))
    )
    entries = F.filter(
        F.transform(F.split("content", mark), strip), lambda e: e != ""
    )
    return first.select(
        "paper_id", F.posexplode(entries).alias("order_index", "raw_text")
    ).select(
        "paper_id",
        stable_id(F.col("paper_id").cast("string"), F.col("order_index").cast("string")).alias(
            "reference_id"
        ),
        "order_index",
        "raw_text",
        first_year(F.col("raw_text")).alias("parsed_year"),
    )


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Full text (pages in order, a blank line between) and page count per paper."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("paper_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("full_text"),
        F.count(F.lit(1)).cast("int").alias("num_pages"),
    )


def sections_by_type(sections: DataFrame) -> DataFrame:
    """Map section type -> its contents in section order, each after a newline.
    The map keeps types in the order they first appear."""
    per_type = sections.groupBy("paper_id", "section_type").agg(
        F.min("order_index").alias("first_index"),
        F.array_sort(F.collect_list(F.struct("order_index", "content"))).alias("parts"),
    )
    text = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("\n"), p["content"])), "")
    return (
        per_type.select("paper_id", "first_index", "section_type", text.alias("text"))
        .groupBy("paper_id")
        .agg(F.array_sort(F.collect_list(F.struct("first_index", "section_type", "text"))).alias("s"))
        .select(
            "paper_id",
            F.map_from_entries(
                F.transform("s", lambda e: F.struct(e["section_type"], e["text"]))
            ).alias("sections"),
        )
    )
