import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import report
from folioscope.sources import catalog, feeds, responses

ENTRY = """<entry><id>http://arxiv.org/abs/{id}</id><updated>2021-03-04T05:06:07Z</updated><published>2020-01-02T03:04:05Z</published>
<title>Dunes on
  Mars</title><summary>  Sand &amp; wind
move. </summary><author><name>Ada Quist</name></author><author><name>Ben Ruoff</name></author><author><name></name></author>
<arxiv:primary_category xmlns:arxiv="http://arxiv.org/schemas/atom" term="physics.geo-ph" scheme="s"/><category term="physics.geo-ph" scheme="s"/><category term="astro-ph.EP"/>
<link href="http://arxiv.org/abs/{id}" rel="alternate" type="text/html"/>{pdf}</entry>"""
PDF = '<link title="pdf" href="http://arxiv.org/pdf/{id}" rel="related" type="application/pdf"/>'


def feed(*entries):
    return ('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom" '
            'xmlns:arxiv="http://arxiv.org/schemas/atom"><title type="text">q</title><id>x</id>' + "".join(entries) + "</feed>")


def test_atom(spark, tmp_path):
    one, two = "2001.00042v2", "2002.00077v1"
    (tmp_path / "a.xml").write_text(feed(ENTRY.format(id=one, pdf=PDF.format(id=one)), ENTRY.format(id=two, pdf=""),
                                         "<entry><title>no id</title></entry>"))
    (tmp_path / "empty.xml").write_text(feed())
    got = feeds.read_atom(spark, str(tmp_path)).orderBy("arxiv_id").collect()
    assert [r.arxiv_id for r in got] == [one, two]
    first = got[0]
    assert first.title == "Dunes on Mars" and first.abstract == "Sand & wind move."
    assert first.authors == ["Ada Quist", "Ben Ruoff"] and first.categories == ["physics.geo-ph", "astro-ph.EP"]
    assert first.primary_category == "physics.geo-ph" and first.pdf_url == f"http://arxiv.org/pdf/{one}"
    assert got[1].pdf_url == f"https://arxiv.org/pdf/{two}" and first.published_at.year == 2020
    assert first.arxiv_base_id == "2001.00042"


def test_malformed_atom_fails(spark):
    bad = spark.createDataFrame([("<feed><entry><id>x</id>",)], "v STRING")
    with pytest.raises(Exception):
        feeds.parse_feeds(bad, "v").collect()


PAYLOAD = {"total": 2, "data": [
    {"paperId": "abc", "title": " Dust ", "abstract": None, "year": 2018, "venue": "Dune Letters", "citationCount": 5,
     "authors": [{"authorId": "1", "name": " Quist "}, {"name": None}], "externalIds": {"ArXiv": "2001.00042", "CorpusId": 7},
     "openAccessPdf": {"url": "u"}},
    {"paperId": "def", "title": None, "year": None, "venue": "", "openAccessPdf": None, "externalIds": None},
    {"title": "no id"}, "text", None]}


def bodies(spark, *items):
    return spark.createDataFrame([(i if isinstance(i, str) else json.dumps(i),) for i in items], "v STRING")


def test_search_json(spark):
    got = feeds.parse_search_payloads(bodies(spark, PAYLOAD), "v").orderBy("source_id").collect()
    assert [r.source_id for r in got] == ["abc", "def"]
    a, d = got
    assert (a.title, a.abstract, a.authors, a.arxiv_id, a.doi, a.pdf_url, a.venue) == (
        "Dust", "", ["Quist"], "2001.00042", None, "u", "Dune Letters")
    assert (d.title, d.venue, d.pdf_url, d.authors, d.year, d.published_on) == ("", None, None, [], None, None)
    for bad in ([1, 2], {"total": 0}, {"data": "x"}, {"data": {"a": 1}}):
        with pytest.raises(Exception):
            feeds.parse_search_payloads(bodies(spark, bad), "v").collect()
    assert feeds.parse_search_payloads(bodies(spark, {"data": []}), "v").count() == 0


def test_unify(spark):
    entries = feeds.parse_feeds(spark.createDataFrame([(feed(ENTRY.format(id="1v1", pdf="")),)], "v STRING"), "v")
    found = feeds.parse_search_payloads(bodies(spark, PAYLOAD), "v")
    broken = lambda: spark.read.parquet("/no/such/folder")
    loaders = {"arxiv": lambda: catalog.from_feed(entries), "semantic_scholar": lambda: catalog.from_search(found), "x": broken}
    with pytest.warns(catalog.SourceLeftOut, match="x: .*no/such/folder"):
        assert catalog.unify(loaders).count() == 3
    assert {r.source for r in catalog.unify(loaders, ["arxiv"]).collect()} == {"arxiv"}
    row = catalog.unify(loaders, ["arxiv"]).first()
    assert row.year == 2020 and row.venue is None and row.citation_count is None
    with pytest.warns(catalog.SourceLeftOut), pytest.raises(catalog.DiscoveryError):
        catalog.unify({"x": broken})


def test_ingest_and_upsert(spark):
    papers = spark.createDataFrame([("a", "completed", "old"), ("b", "failed", "old")], "arxiv_id STRING, extraction_status STRING, title STRING")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "arxiv_id STRING")
    assert sorted(r.arxiv_id for r in catalog.plan_ingest(asked, papers).collect()) == ["b", "c"]
    incoming = asked.withColumn("extraction_status", F.lit("extracting")).withColumn("title", F.lit("new"))
    got = {r.arxiv_id: r.title for r in catalog.upsert_papers(papers, incoming).collect()}
    assert got == {"a": "old", "b": "new", "c": "new"}


def test_authors(spark):
    names = spark.createDataFrame([(2, " ANA "), (1, "Ana"), (3, "Bo")], "at INT, name STRING")
    assert {tuple(r) for r in catalog.resolve_authors(names, ["at"]).collect()} == {("ana", "Ana"), ("bo", "Bo")}


def test_responses_and_fallback(spark):
    good = '```json\n{"methods": [{"name": "M", "description": "d"}, {"name": ""}], "datasets": [{"name": "D"}], ' \
           '"metrics": [{"name": "acc"}], "claims": [{"description": ""}, {"description": "c", "evidence": "e"}, {"description": "f"}]}\n```'
    rows = [("a", "A", 0, good), ("b", "B", 1, "sorry"), ("c", "C", 2, "[1]"), ("d", "D", 3, "{}"), ("e", "E", 4, None)]
    df = spark.createDataFrame(rows, "paper_id STRING, title STRING, paper_ord BIGINT, response STRING")
    facts = responses.parse_responses(df)
    got = [(f.entity_type, f.name, f.description, f.evidence) for f in facts.orderBy("ord").collect()]
    assert got == [("method", "M", "d", "d"), ("dataset", "D", None, None), ("metric", "acc", None, None),
                   ("claim", "A — claim 2", "c", "e"), ("claim", "A — claim 3", "f", "f")]
    assert {f.confidence for f in facts.collect()} == {0.85}
    assert sorted(r.paper_id for r in responses.parsed_papers(df).collect()) == ["a", "d"]
    heuristic = facts.where("false").unionByName(
        facts.limit(1).select(F.explode(F.array(*map(F.lit, "abd"))).alias("paper_id"), *[c for c in facts.columns if c != "paper_id"]))
    merged = responses.coalesce_extractions(facts, heuristic, responses.parsed_papers(df))
    assert sorted({r.paper_id for r in merged.collect()}) == ["a", "b"]
    with pytest.raises(Exception):
        responses.parse_responses(df, strict=True).collect()


def test_listing_detail_cards(spark):
    papers = spark.createDataFrame([(f"p{i}", i) for i in range(5)], "paper_id STRING, created_at INT")
    assert [r.paper_id for r in report.list_papers(papers, 2, 1).collect()] == ["p3", "p2"]
    with pytest.raises(ValueError):
        report.list_papers(papers, 201)
    bridge = spark.createDataFrame([("p0", "x", 1), ("p0", "y", 0)], "paper_id STRING, author_id STRING, author_order INT")
    people = spark.createDataFrame([("x", "X"), ("y", "Y")], "author_id STRING, name STRING")
    sections = spark.createDataFrame([("p0", 0, "h", "results", 0, 0, "c" * 2001), ("p0", 1, "r", "references", 0, 0, "c")],
                                     "paper_id STRING, order_index INT, heading STRING, section_type STRING, page_start INT, page_end INT, content STRING")
    refs = spark.createDataFrame([("p1", 0, "raw", 2017)], "paper_id STRING, order_index INT, raw_text STRING, parsed_year INT")
    detail = {r.paper_id: r for r in report.paper_detail(papers, bridge, people, sections, refs).collect()}
    assert detail["p0"].authors == ["Y", "X"] and len(detail["p0"].sections) == 2 and detail["p0"].references == []
    assert len(detail) == 5 and detail["p1"].references[0].parsed_year == 2017
    (preview,) = report.section_previews(sections).collect()
    assert len(preview.preview) == 2001 and preview.preview.endswith("…")
    cards = report.paper_cards(spark.createDataFrame([(["a", "b", "c", "d"],), (None,)], "authors ARRAY<STRING>"))
    assert sorted(r.author_line for r in cards.collect()) == ["", "a, b, c, et al."]
    assert {tuple(r) for r in report.status_funnel(papers.withColumn("extraction_status", F.lit("completed"))).collect()} == {("completed", 5)}


def test_responses_are_json_and_nothing_else(spark):
    good = '{"methods": [{"name": "M"}]}'
    bad = ["{'methods': [{'name': 'M'}]}", good + " as asked", "```json\n" + good + "\n```\nHope this helps.", good + ", " + good,
           '{"methods": [{"name": NaN}]}', "[" + good + "]", "", None]
    rows = [(f"p{i}", "t", i, r) for i, r in enumerate([good, "```json\n" + good + "\n```", *bad])]
    df = spark.createDataFrame(rows, "paper_id STRING, title STRING, paper_ord BIGINT, response STRING")
    assert {r.paper_id for r in responses.parsed_papers(df).collect()} == {"p0", "p1"}
    assert {r.paper_id for r in responses.parse_responses(df).collect()} == {"p0", "p1"}


def test_upsert_takes_the_last_of_equal_rows(spark):
    schema = "arxiv_id STRING, title STRING, extraction_status STRING, at INT"
    papers = spark.createDataFrame([("a", "done", "completed", 0), ("b", "old", "failed", 0)], schema)
    incoming = spark.createDataFrame([("a", "new", "pending", 9), ("b", "second", "pending", 2), ("b", "zz first", "pending", 1)], schema)
    got = {r.arxiv_id: r.title for r in catalog.upsert_papers(papers, incoming, order=["at"]).collect()}
    assert got == {"a": "done", "b": "second"}


@pytest.mark.parametrize("after, answered", [
    ("", True), ("  \n", True), ("] trailing prose", False), ('] [{"x": 1}', False), ("} trailing", False), (', "x": {}', False),
    (', {"x": 1}', False), (" trailing", False), ("}", False), ("]", False), (', "r": 1}', False),
])
def test_only_a_whole_object_is_an_answer(spark, after, answered):
    body = '{"methods": [{"name": "M", "description": "d"}]}' + after
    df = spark.createDataFrame([("p", "T", 0, body), ("q", "T", 1, f"```json\n{body}\n```")], "paper_id STRING, title STRING, paper_ord INT, response STRING")
    want = {"p", "q"} if answered else set()
    assert {r.paper_id for r in responses.parse_responses(df).collect()} == want
    assert {r.paper_id for r in responses.parsed_papers(df).collect()} == want


def test_store_rewrites_only_touched_shards(spark, tmp_path):
    from folioscope.sources.store import PaperStore

    store = PaperStore(str(tmp_path / "store"), "id", shards=32)
    papers = lambda rows: spark.createDataFrame(rows, "id STRING, title STRING, extraction_status STRING")
    parts = lambda rows: spark.createDataFrame(rows, "id STRING, at INT, body STRING")
    many = [f"p{i}" for i in range(60)]
    store.upsert(papers([(p, "T", "completed" if k % 2 else "failed") for k, p in enumerate(many)]),
                 parts([(p, k, "old") for p in many for k in range(2)]), parts([(p, 0, "ref") for p in many]))
    files = lambda: {f: (f.stat().st_mtime_ns, f.read_bytes()) for f in (tmp_path / "store").rglob("*.parquet")}
    before = files()
    # a failed one, a completed one, a new one, one that now has no parts; parts of a paper not named
    run = papers([("p0", "New", "completed"), ("p1", "New", "completed"), ("q", "Q", "failed"), ("p2", "Bare", "completed"), (None, "x", "failed")])
    store.upsert(run, parts([("p0", 0, "new"), ("p1", 0, "new"), ("q", 0, "new"), ("p4", 0, "stray")]), parts([("p0", 0, "new")]))
    after = files()
    touched = {f"shard={r.s}" for r in run.where("id is not null").selectExpr("pmod(xxhash64(id), 32) AS s").collect()}
    assert {f: v for f, v in before.items() if f.parent.name not in touched} == {f: v for f, v in after.items() if f.parent.name not in touched}
    assert len(touched) <= 4 < len({f.parent.name for f in after})
    rows = {r.id: r for r in store.table(run, "papers").collect()}
    assert len(rows) == 61 and rows["p0"].title == "New" and rows["p1"].title == "T" and rows["p0"].extraction_status == "completed"
    bodies = {}
    for r in store.table(parts([("a", 0, "")]), "sections").collect():
        bodies.setdefault(r.id, []).append(r.body)
    assert bodies["p0"] == ["new"] and bodies["p1"] == bodies["p4"] == ["old", "old"] and bodies["q"] == ["new"] and "p2" not in bodies
    assert {r.id for r in store.table(parts([("a", 0, "")]), "references").collect()} == set(many) - {"p2"}
    store.upsert(run.limit(0), parts([]), parts([]))
    assert store.table(run, "papers").count() == 61
