import random

import pytest
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.functions.text import normalize_title
from folioscope.operators import graph
from folioscope.operators.citations import citation_match

TITLES = [("p1", "Slow-Growing Lichens as Clocks for Moving Glaciers"),
          ("p2", "Pollen Drift Models"),
          ("p3", "Counting Rings in Buried Oaks")]
REFS = [("q", "r1", "Aalto, R.; Berg, S. Slow-Growing Lichens as Clocks for Moving Glaciers. Polar Notes 2011."),
        ("q", "r2", "Ives, C. et al. Pollen Drift Models. Air 2014."),
        ("q", "r3", "Okoro, D. Counting Rings in Buried Oaks. Wood 2009."),
        ("q", "r4", "Perez, L. On repairing wooden boats. 2019."),
        ("q", "r5", "POLLEN DRIFT MODELS; second look, 2015"),
        ("p2", "r6", "Pollen Drift Models")]


def match(spark, refs, titles, **kw):
    r = spark.createDataFrame(refs, "paper_id STRING, reference_id STRING, raw_text STRING")
    t = spark.createDataFrame(titles, "paper_id STRING, title STRING")
    return {(m.reference_id, m.cited_paper_id): m.match_confidence for m in citation_match(r, t, **kw).collect()}


def test_citation_facts(spark):
    got = match(spark, REFS, TITLES)
    assert set(got) == {("r1", "p1"), ("r2", "p2"), ("r3", "p3"), ("r5", "p2")}
    assert all(0 <= c <= 1 for c in got.values())
    assert match(spark, [("q", "r", "a word on tides by the way")], [("s", "On Tides")]) == {}
    assert match(spark, [], TITLES) == {} and match(spark, REFS, []) == {}


def test_citation_equals_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    text = lambda n: rng.choice([" ", "-"]).join(word() for _ in range(n))
    titles = [(f"t{i}", text(rng.randint(1, 6))) for i in range(300)]
    titles += [(f"c{i}", titles[i][1].upper()) for i in range(20)]
    refs = [("x", f"r{i}", text(rng.randint(1, 25))) for i in range(200)]
    clean = lambda s: s.replace("-", " ").lower()
    for least in (1, 4, 8):
        want = {(r, t) for _, r, raw in refs for t, title in titles
                if len(clean(title)) >= least and clean(title) in clean(raw)}
        assert set(match(spark, refs, titles, min_title_length=least)) == want, least


def test_resolution_keeps_first_mention(spark):
    raw = spark.createDataFrame(
        [("a", 0, 0, "dataset", " Cora ", "first", "heuristic", 0.6),
         ("b", 1, 0, "dataset", "CORA", "second", "llm", 0.85),
         ("b", 1, 1, "claim", "B — claim 1", "text", "heuristic", 0.6),
         ("b", 1, 2, "method", "cora", None, "heuristic", 0.6)], schemas.RAW_ENTITIES)
    papers = spark.createDataFrame([("a", "Paper A", "abs", 0), ("b", "Paper B", None, 1)],
                                   "paper_id STRING, title STRING, abstract STRING, ord BIGINT")
    got = {(e.entity_type, e.name): e for e in graph.resolve_entities(raw, papers).collect()}
    assert set(got) == {("dataset", "Cora"), ("claim", "B — claim 1"), ("method", "cora"),
                        ("paper", "Paper A"), ("paper", "Paper B")}
    assert got["dataset", "Cora"].description == "first" and got["dataset", "Cora"].source_paper_id is None
    assert got["claim", "B — claim 1"].source_paper_id == "b"
    assert got["paper", "Paper A"].confidence == 1.0 and got["paper", "Paper A"].extraction_method == "direct"
    rest = graph.resolve_entities(raw, papers, existing=graph.resolve_entities(raw.where("paper_id = 'a'")))
    assert rest.count() == 4


def graph_tables(spark):
    raw = spark.createDataFrame(
        [("a", 0, 0, "method", "M", None, "heuristic", 0.6),
         ("a", 0, 1, "dataset", "m", None, "heuristic", 0.6),
         ("a", 0, 2, "claim", "A — claim 1", "c", "heuristic", 0.6)], schemas.RAW_ENTITIES)
    rels = spark.createDataFrame(
        [("a", 0, "A", "M", "proposes", "e", 0.6), ("a", 2, "A", "A — claim 1", "mentions", "c", 0.6),
         ("a", 3, "A", "nowhere", "mentions", "x", 0.6)], schemas.RAW_RELATIONSHIPS)
    papers = spark.createDataFrame([("a", "A", None, 0), ("b", "B", None, 1)],
                                   "paper_id STRING, title STRING, abstract STRING, ord BIGINT")
    return raw, rels, papers


def test_edges_use_later_mention_and_drop_dangling(spark):
    raw, rels, papers = graph_tables(spark)
    names = {e.entity_id: (e.entity_type, e.name) for e in graph.resolve_entities(raw, papers).collect()}
    edges = graph.resolve_edges(rels, raw, papers).collect()
    assert {(names[e.source_entity_id], names[e.target_entity_id]) for e in edges} == {
        (("paper", "A"), ("dataset", "m")), (("paper", "A"), ("claim", "A — claim 1"))}


def test_subgraph_and_counts(spark):
    raw, rels, papers = graph_tables(spark)
    entities = graph.resolve_entities(raw, papers)
    edges = graph.resolve_edges(rels, raw, papers)
    ids = papers.where("paper_id = 'a'").select("paper_id")
    nodes, links = graph.paper_subgraph(entities, edges, papers, ids)
    assert sorted(n.name for n in nodes.collect()) == ["A", "A — claim 1", "m"]
    assert links.count() == 2
    strict, _ = graph.paper_subgraph(entities, edges, papers, ids, strict=True)
    assert sorted(n.name for n in strict.collect()) == ["A", "A — claim 1"]
    assert {(r.entity_type, r.nodes) for r in graph.nodes_by_type(nodes).collect()} == {("claim", 1), ("dataset", 1)}


def test_citation_edges_one_per_match(spark):
    matches = spark.createDataFrame(
        [("a", "r1", "b", "B", 0.9), ("a", "r2", "b", "B", 0.8)],
        "paper_id STRING, reference_id STRING, cited_paper_id STRING, cited_title STRING, match_confidence DOUBLE")
    _, _, papers = graph_tables(spark)
    edges = graph.citation_edges(matches, papers).collect()
    assert len(edges) == 2 and len({(e.source_entity_id, e.target_entity_id) for e in edges}) == 1
    assert {e.evidence for e in edges} == {"B"}


def test_export_merges_and_rejects(spark, tmp_path):
    raw, rels, papers = graph_tables(spark)
    entities = graph.resolve_entities(raw, papers)
    edges = graph.resolve_edges(rels, raw, papers)
    twice = edges.unionByName(edges.withColumn("ord", F.col("ord") + 10).withColumn("evidence", F.lit("late")))
    graph.export_graph(entities, twice, str(tmp_path / "g"), "ord")
    back = spark.read.parquet(str(tmp_path / "g" / "edges"))
    assert {r.evidence for r in back.collect()} == {"late"} and back.count() == 2
    assert spark.read.parquet(str(tmp_path / "g" / "nodes")).count() == entities.count()
    with pytest.raises(Exception, match="unrecognised"):
        graph.merge_edges(edges.withColumn("relationship_type", F.lit("likes")), "ord").collect()


def test_normalized_title_column(spark):
    row = spark.range(1).select(normalize_title(F.lit("A--B  c!")).alias("t")).first()
    assert row.t == "a b c"


def test_subgraph_keeps_parallel_edges_and_loops(spark):
    paper = lambda t: graph.paper_entity_id(F.lit(t))
    papers = spark.createDataFrame([("p", "One"), ("q", "Two"), ("r", "Three")], "paper_id STRING, title STRING")
    entities = papers.select(
        F.col("paper_id").alias("source_paper_id"), graph.paper_entity_id(F.col("title")).alias("entity_id"),
        F.lit("paper").alias("entity_type"), F.col("title").alias("name"), F.lit(1.0).alias("confidence"))
    rows = spark.createDataFrame(
        [("One", "Two", "e"), ("One", "Two", "e"), ("One", "One", "loop"), ("Two", "One", "back"), ("Two", "Three", "far")],
        "s STRING, t STRING, evidence STRING")
    relationships = rows.select(
        F.lit("p").alias("paper_id"), paper("One").alias("source_entity_id"), paper("Two").alias("target_entity_id"),
        F.lit("cites").alias("relationship_type"), "evidence", "s", "t").withColumns(
        {"source_entity_id": graph.paper_entity_id(F.col("s")), "target_entity_id": graph.paper_entity_id(F.col("t"))}).drop("s", "t")
    _, edges = graph.paper_subgraph(entities, relationships, papers, papers.where("paper_id = 'p'").select("paper_id"))
    assert sorted(r.evidence for r in edges.collect()) == ["back", "e", "e", "loop"]


def test_merges_do_not_depend_on_the_order_of_rows(spark):
    edges = [("a", "b", "cites", f"e{i}", float(i % 3), 1) for i in range(6)]
    nodes = [("method", "m", f"name {i}", 1) for i in range(6)]
    for turn in (1, -1):
        e = spark.createDataFrame(edges[::turn], "source_entity_id STRING, target_entity_id STRING, relationship_type STRING, evidence STRING, confidence DOUBLE, at INT")
        n = spark.createDataFrame(nodes[::turn], "entity_type STRING, entity_id STRING, name STRING, at INT")
        assert graph.merge_edges(e.repartition(3), "at").first().evidence == "e5"
        assert graph.merge_nodes(n.repartition(3), "at").first().name == "name 5"
