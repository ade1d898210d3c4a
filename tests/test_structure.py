import random

from folioscope import schemas
from folioscope.operators.extraction import extract_knowledge
from folioscope.operators.structure import (
    HEADINGS,
    assemble_pages,
    segment_sections,
    split_references,
)

PAPER = [
    ("Abstract", "River ice breaks earlier each decade."),
    ("1. Introduction", "Ferries depend on the date."),
    ("2. Related Work", "Logs of three ports exist."),
    ("3. Methodology", "Dates are read from ledgers."),
    ("4. Experiments", "Four rivers are compared."),
    ("5. Results", "The date moves by 2.5 days."),
    ("6. Limitations", "Two ledgers are torn."),
    ("7. Conclusion", "More ports should be read."),
    ("References", "[1] Nyman, O. Ledgers of the North. 1998.\n[2] Brandt, E. Ice and Ferries. 2004.\n"
                   "[3] Laine, P. Reading Torn Pages. 2012."),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, schemas.PAPER_PAGES)


def test_paper_sections_and_references(spark):
    df = pages(spark, [("p", i, f"{h}\n{t}") for i, (h, t) in enumerate(PAPER)])
    sections = segment_sections(df)
    got = sections.orderBy("order_index").collect()
    assert [r.section_type for r in got] == [
        "abstract", "introduction", "related_work", "methodology", "experiments", "results",
        "limitations", "conclusion", "references"]
    assert [r.order_index for r in got] == list(range(9))
    assert [(r.page_start, r.page_end) for r in got][:2] == [(0, 1), (1, 2)]
    refs = split_references(sections).orderBy("order_index").collect()
    assert [r.parsed_year for r in refs] == [1998, 2004, 2012]
    assert refs[0].raw_text.startswith("Nyman")
    assert split_references(sections.where("section_type <> 'references'")).count() == 0


def test_no_pages_no_sections(spark):
    assert segment_sections(pages(spark, [])).count() == 0
    assert segment_sections(pages(spark, [("p", 0, "")])).count() == 0


def fold(texts, kinds):
    """The sequential rule, line by line."""
    out, state = [], ["Preamble", "body", [], 0]

    def close(page):
        content = "\n".join(state[2]).strip()
        if content:
            out.append((len(out), state[0], state[1], state[3], page, content))

    for page, text in enumerate(texts):
        for line in text.splitlines():
            bare = line.strip()
            if bare in kinds:
                close(page)
                state[:] = [bare, kinds[bare], [], page]
            else:
                state[2].append(line)
    close(len(texts) - 1)
    return out


def test_sections_equal_sequential_rule(spark):
    rng = random.Random(7)
    kinds = {"Abstract": "abstract", "2 Results": "results", "REFERENCES": "references"}
    rows, want = [], {}
    for p in range(40):
        texts = []
        for _ in range(rng.randint(1, 6)):
            lines = [rng.choice([*kinds, "x", "", "  y ", "results are good", "\x0b"]) for _ in range(rng.randint(0, 6))]
            texts.append(rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"]))
        rows += [(f"p{p}", i, t) for i, t in enumerate(texts)]
        want[f"p{p}"] = fold(texts, kinds)
    rng.shuffle(rows)
    got = {}
    for r in segment_sections(pages(spark, rows), HEADINGS).orderBy("paper_id", "order_index").collect():
        got.setdefault(r.paper_id, []).append(
            (r.order_index, r.heading, r.section_type, r.page_start, r.page_end, r.content))
    assert got == {k: v for k, v in want.items() if v}


def test_assemble_pages(spark):
    df = pages(spark, [("p", 1, "b"), ("p", 0, "a"), ("q", 0, "c")])
    assert {(r.paper_id, r.full_text, r.num_pages) for r in assemble_pages(df).collect()} == {
        ("p", "a\n\nb", 2), ("q", "c", 1)}


SECTIONS = {
    "introduction": "Strong results. In this paper, we propose GraphMix, a new architecture.",
    "methodology": "We propose GraphMix, which combines both. We introduce a Contrastive Alignment loss.",
    "experiments": "We evaluate GraphMix on Cora, Citeseer, and PubMed. We report accuracy and F1 score.",
    "results": "GraphMix achieves 84.2% accuracy on Cora, a 2.1 points improvement. On Citeseer, 73.5 percent.",
}


def extraction(spark, sections):
    rows = [("p", i, "h", k, 0, 0, v) for i, (k, v) in enumerate(sections.items())]
    papers = spark.createDataFrame([("p", "GraphMix Paper", 0)], "paper_id STRING, title STRING, ord BIGINT")
    entities, edges = extract_knowledge(spark.createDataFrame(rows, schemas.SECTIONS), papers)
    return entities.collect(), edges.collect()


def test_extraction_facts(spark):
    entities, edges = extraction(spark, SECTIONS)
    by = lambda kind: [e.name for e in sorted(entities, key=lambda e: e.ord) if e.entity_type == kind]
    assert by("method") == ["GraphMix", "Contrastive Alignment"]
    assert by("dataset") == ["Citeseer", "Cora", "PubMed"]
    assert by("metric") == ["F1", "F1 score", "accuracy"]
    assert by("claim") == ["GraphMix Paper — claim 1", "GraphMix Paper — claim 2"]
    assert "84.2%" in [e.description for e in entities if e.entity_type == "claim"][0]
    assert {e.source_name for e in edges} == {"GraphMix Paper"}
    assert {(e.relationship_type) for e in edges} == {"proposes", "evaluated_on", "mentions"}
    assert all(e.confidence == 0.6 and e.extraction_method == "heuristic" for e in entities)


def test_extraction_empty_and_missing_sections(spark):
    assert extraction(spark, {}) == ([], [])
    entities, _ = extraction(spark, {"introduction": "accuracy of 5% on Cora"})
    assert {e.entity_type for e in entities} == {"dataset"}
    entities, _ = extraction(spark, {"experiments": "It gains 5%."})
    assert [e.description for e in entities if e.entity_type == "claim"] == ["It gains 5%."]
