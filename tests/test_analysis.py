import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators import analysis, figures, gaps, novelty, overlap, report


def knowledge(spark, rows):
    full = []
    for i, r in enumerate(rows):
        full.append((r.get("id", f"id{i}"), r["t"], r.get("y"), i, r.get("m"), r.get("d"), r.get("c"), r.get("cites")))
    return spark.createDataFrame(full, schemas.KNOWLEDGE)


A = {"t": "A", "m": ["MethodA"], "d": ["Cora"], "c": ["MethodA achieves 84.2% accuracy on Cora."]}
B = {"t": "B", "m": ["MethodB"], "d": ["Cora"], "c": ["MethodB achieves 71.0% accuracy on Cora."]}


def test_contradictions(spark):
    def found(*rows, **kw):
        return figures.contradictions(figures.claim_figures(knowledge(spark, rows)), **kw).collect()

    (one,) = found(A, B)
    assert (one.dataset, one.figures, one.spread) == ("Cora", 2, 13.2)
    assert found(A, {**B, "c": ["83.9% on Cora"]}) == []
    assert found(A) == [] and found() == []
    assert found(A, {**B, "c": ["fast on Cora"]}, {"t": "N"}) == []
    both = {**A, "c": ["10% Cora", "90% cora"]}
    assert len(found(both)) == 1 and found(both, distinct_papers=True) == []


def test_gaps(spark):
    rows = [{"t": "A", "m": ["M1"], "d": ["RareSet"]}, {"t": "B", "m": ["M2"], "d": ["Cora"]},
            {"t": "C", "m": ["M3"], "d": ["Cora"]}, {"t": "D", "m": ["OrphanMethod"]}]
    k = knowledge(spark, rows)
    got = {(g.kind, g.subject) for g in gaps.gaps(k, analysis.paper_concepts(k)).collect()}
    assert got == {("underexplored_dataset", "RareSet"), ("unevaluated_method", "OrphanMethod")}


def test_timelines(spark):
    rows = [{"t": "A", "y": 2017, "d": ["Cora"], "c": ["81.5% on Cora."]},
            {"t": "C", "y": 2020, "d": ["Cora"], "c": ["84.2% on Cora."]},
            {"t": "B", "y": 2018, "d": ["Cora"], "c": ["83.0% on Cora."]},
            {"t": "U", "d": ["Cora"], "c": ["99% on Cora."]}]
    f = figures.claim_figures(knowledge(spark, rows))
    (one,) = figures.timelines(f).collect()
    assert (one.points, one.first_value, one.last_value, one.improved) == (3, 81.5, 84.2, True)
    points = figures.timeline_points(f).orderBy("point").collect()
    assert [(p.point, p.year) for p in points] == [(0, 2017), (1, 2018), (2, 2020)]
    assert figures.timelines(figures.claim_figures(knowledge(spark, rows[:1] + rows[3:]))).collect() == []


def brute_novelty(rows):
    entries = [(r["t"], m) for r in rows for m in r.get("m", [])]
    words = lambda n: set(re.findall("[a-z]+", n.lower()))
    out = {}
    for t, m in entries:
        w = words(m)
        n = sum(1 for t2, m2 in entries
                if (t2, m2) != (t, m) and w and len(w & words(m2)) / len(w) >= 0.5)
        out[t, m] = round(max(0.0, 1.0 - 0.3 * n), 2)
    return out


def test_novelty_facts(spark):
    rows = [{"t": "A", "m": ["GraphMix", "QuantumFlow"]}, {"t": "B", "m": ["GraphMix Plus", "123"]}]
    concepts = analysis.paper_concepts(knowledge(spark, rows))
    got = {(r.paper_title, r.method): r.novelty_score for r in novelty.novelty(concepts).collect()}
    assert got == {("A", "GraphMix"): 0.7, ("A", "QuantumFlow"): 1.0, ("B", "GraphMix Plus"): 0.7, ("B", "123"): 1.0}
    pairs = {(r.method, r.similar) for r in novelty.novelty_overlap(concepts).collect()}
    assert pairs == {("GraphMix", "GraphMix Plus"), ("GraphMix Plus", "GraphMix")}


@pytest.mark.parametrize("max_words", [2, 8])
def test_novelty_equals_all_pairs(spark, max_words):
    rng = random.Random(5)
    name = lambda: " ".join(rng.choice(["net", "net", "graph", "x", "deep", "Mix", "7"]) for _ in range(rng.randint(1, 5)))
    rare = lambda: "".join(rng.choice("abcdefgh") for _ in range(3)) + " " + rng.choice("pqrst")
    rows = [{"t": f"T{rng.randint(0, 25)}", "m": [rng.choice([name, rare])() for _ in range(rng.randint(0, 3))]} for _ in range(40)]
    rows.append({"t": "T1", "m": ["solo word", "solo word"]})
    concepts = analysis.paper_concepts(knowledge(spark, rows))
    got = {(r.paper_title, r.method): r.novelty_score for r in novelty.novelty(concepts, max_words=max_words).collect()}
    assert got == brute_novelty(rows)


def random_papers(seed, n=60):
    rng = random.Random(seed)
    pool = [f"c{i}" for i in range(14)]
    rows = []
    for i in range(n):
        title = f"T{rng.randint(0, n)}"
        pick = lambda: sorted({rng.choice(pool[: rng.choice([3, 14])]) for _ in range(rng.randint(0, 5))})
        rows.append({"id": f"p{i:03d}", "t": title, "m": pick(), "d": pick()})
    rows += [{"id": f"z{i}", "t": f"copy{i % 2}", "m": ["c1", "c2"], "d": ["c3"]} for i in range(9)]
    return rows


def brute_impact(rows):
    out = {}
    for r in rows:
        n = sum(1 for o in rows if o["t"] != r["t"]
                and (set(r["m"]) & set(o["m"]) or set(r["d"]) & set(o["d"])))
        out[r["id"]] = n
    return out


def brute_recommend(rows, k):
    out = {}
    for r in rows:
        mine = set(r["m"]) | set(r["d"])
        scored = []
        for i, o in enumerate(rows):
            shared = mine & (set(o["m"]) | set(o["d"]))
            if o["t"] != r["t"] and shared:
                scored.append((-round(len(shared) / len(mine) + 1e-9, 2), i, o["id"], len(shared)))
        out[r["id"]] = [(x[2], x[3]) for x in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("popular", [0, 8, 14, 30, 64])
def test_overlap_equals_all_pairs(spark, monkeypatch, popular):
    monkeypatch.setattr(overlap, "RANGE", 16)
    monkeypatch.setattr(overlap, "SETS", 4)
    rows = random_papers(11)
    k = knowledge(spark, rows)
    concepts = analysis.paper_concepts(k)
    got = {r.paper_id: r.shared_with for r in overlap.impact(
        concepts, k.select("paper_id", "paper_title"), popular=popular).collect()}
    assert got == brute_impact(rows)
    recs = {}
    for r in overlap.recommend(concepts, 3, popular=popular).orderBy("paper_id", "position").collect():
        recs.setdefault(r.paper_id, []).append((r.recommended_id, r.shared))
    assert recs == {p: v for p, v in brute_recommend(rows, 3).items() if v}


@pytest.mark.parametrize("narrow", [0, 2])
def test_overlap_of_wide_papers(spark, monkeypatch, narrow):
    monkeypatch.setattr(overlap, "RANGE", 16)
    rows = random_papers(5, 40)
    k = knowledge(spark, rows)
    concepts = analysis.paper_concepts(k)
    got = {r.paper_id: r.shared_with for r in overlap.impact(
        concepts, k.select("paper_id", "paper_title"), popular=8, narrow=narrow).collect()}
    assert got == brute_impact(rows)
    recs = {}
    for r in overlap.recommend(concepts, 3, popular=8, narrow=narrow).orderBy("paper_id", "position").collect():
        recs.setdefault(r.paper_id, []).append((r.recommended_id, r.shared))
    assert recs == {p: v for p, v in brute_recommend(rows, 3).items() if v}


def test_frequent_concepts_are_not_paired(spark, monkeypatch):
    """Of concepts of nearly equal frequency none leaves lists of its papers."""
    def no_pairs(*args):
        raise AssertionError("papers were paired")

    monkeypatch.setattr(overlap, "_pairs", no_pairs)
    names = [f"c{i:02d}" for i in range(60)]
    rows = [{"id": f"p{i:03d}", "t": f"T{i}", "m": [c for j, c in enumerate(names) if (i * 7 + j * 5) % 11 < 4 + j % 2], "d": []} for i in range(40)]
    k = knowledge(spark, rows)
    got = {r.paper_id: r.shared_with for r in overlap.impact(
        analysis.paper_concepts(k), k.select("paper_id", "paper_title")).collect()}
    assert got == brute_impact(rows)
    rows = [{"id": f"p{i:03d}", "t": f"T{i}", "m": [f"a{i % 97}", f"b{i % 101}"], "d": [f"c{i % 89}"]} for i in range(200)]
    concepts = analysis.paper_concepts(knowledge(spark, rows))
    recs = {}
    for r in overlap.recommend(concepts, 3).orderBy("paper_id", "position").collect():
        recs.setdefault(r.paper_id, []).append((r.recommended_id, r.shared))
    assert recs == {p: v for p, v in brute_recommend(rows, 3).items() if v}


def test_pairs_of_concepts_are_moved_once(spark, monkeypatch):
    """Papers that meet at pairs of concepts are neither counted nor written first
    where no concept has more than ``SETS`` papers."""
    def not_needed(*args):
        raise AssertionError("rows were dealt into parts")

    monkeypatch.setattr(overlap, "_dealt", not_needed)
    rows = [{"id": f"p{i:03d}", "t": f"T{i // 2}", "m": [f"a{i % 7}", f"b{i % 9}", f"c{i % 5}"], "d": []} for i in range(60)]
    recs = {}
    concepts = analysis.paper_concepts(knowledge(spark, rows))
    for r in overlap.recommend(concepts, 3, popular=0).orderBy("paper_id", "position").collect():
        recs.setdefault(r.paper_id, []).append((r.recommended_id, r.shared))
    assert recs == {p: v for p, v in brute_recommend(rows, 3).items() if v}


@pytest.mark.parametrize("sets", [4, 4096])
def test_lists_that_go_to_papers_are_narrow(spark, monkeypatch, sets):
    """Titles repeat near and far, so that distances fit a byte and do not."""
    monkeypatch.setattr(overlap, "RANGE", 64)
    monkeypatch.setattr(overlap, "SETS", sets)
    rows = [{"id": f"p{i:03d}", "t": f"T{i % 140 if i % 3 else i // 2}", "m": [f"a{i % 41}", f"b{i % 37}", f"c{i * i % 29}", "all"], "d": []} for i in range(290)]
    concepts = analysis.paper_concepts(knowledge(spark, rows))
    profiles, n_popular, tasks, busy = overlap._profiles(concepts, overlap.F.col("concept"), 8, 0, 8)
    plan = overlap._pairs(profiles, n_popular, tasks, busy)._jdf.queryExecution().optimizedPlan()
    while "Repartition" not in plan.nodeName():
        plan = plan.children().head()
    sent = plan.schema().catalogString()
    assert n_popular == 1 and "low:array<smallint>" in sent and "step:array<tinyint>" in sent and "theirs:array<tinyint>" in sent
    recs = {}
    for r in overlap.recommend(concepts, 3, popular=8, narrow=0).orderBy("paper_id", "position").collect():
        recs.setdefault(r.paper_id, []).append((r.recommended_id, r.shared))
    assert recs == {p: v for p, v in brute_recommend(rows, 3).items() if v}


def test_hash_tells_names_apart(spark, monkeypatch):
    names = spark.createDataFrame([("a",), ("b",), ("cc",)], "concept string")
    hashed, tried = overlap.F.xxhash64, []

    def colliding(c, salt):
        tried.append(salt)
        return overlap.F.length(c).cast("bigint") if len(tried) == 1 else hashed(c, salt)

    monkeypatch.setattr(overlap.F, "xxhash64", colliding)
    number = overlap._hashed(names)
    assert len(tried) == 2
    assert names.select(number(overlap.F.col("concept"))).distinct().count() == 3


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(overlap, "ROWS", 100)
    rows = spark.range(1000)
    assert overlap._spread(rows, 1000, "id").rdd.getNumPartitions() == 10
    assert overlap._spread(rows, 300, "id") is rows


def test_shared_names_move_as_lists(spark):
    concepts = spark.createDataFrame(
        [("p", "b"), ("p", "a"), ("p", "a"), ("p", None), ("q", "a"), ("q", "b"), ("q", "c"), ("q", None), ("r", "c"), (None, "a")],
        "paper_id string, concept string")
    best = spark.createDataFrame(
        [("p", 1, "q"), ("q", 1, "p"), ("q", 2, "r"), ("r", 1, "q"), ("r", 2, "q"), (None, 1, "p"), ("p", 2, None), ("p", 3, "r")],
        "paper_id string, position int, recommended_id string")
    named = overlap.shared_concepts(best, concepts)
    assert named.columns == ["paper_id", "recommended_id", "position", "shared_concepts"]
    assert {(r.paper_id, r.position): (r.recommended_id, r.shared_concepts) for r in named.collect()} == {
        ("p", 1): ("q", ["a", "b"]), ("q", 1): ("p", ["a", "b"]), ("q", 2): ("r", ["c"]), ("r", 1): ("q", ["c", "c"]), ("r", 2): ("q", ["c", "c"]),
        (None, 1): ("p", None), ("p", 2): (None, None), ("p", 3): ("r", None)}
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, .*concept#", plan) and "array_intersect" in plan


def test_recommend_details(spark):
    rows = [{"t": "A", "d": ["Cora", "Citeseer"]}, {"t": "B", "d": ["Cora"]}, {"t": "C", "d": ["X"]}]
    k = knowledge(spark, rows)
    concepts = analysis.paper_concepts(k)
    recs = overlap.recommend(concepts)
    named = overlap.shared_concepts(recs, concepts).where("paper_id = 'id0'").first()
    assert (named.recommended_title, named.shared_concepts, named.score) == ("B", ["Cora"], 0.5)
    everyone = overlap.with_empty(recs, k)
    assert everyone.where("paper_id = 'id2' and recommended_id is null").count() == 1


def test_paper_analysis(spark):
    rows = [{"t": "A", "m": ["M2", "M1"], "d": ["Cora"], "c": ["one", "two", "three"]}, {"t": "B", "d": ["Cora"]}, {"t": "C", "d": ["Other"]},
            {"t": "D"}]
    got = {r.paper_title: r for r in analysis.paper_analysis(knowledge(spark, rows)).collect()}
    assert got["A"].impact_score == 0.33 and got["C"].impact_score == 0.0
    assert got["A"].evidence_density == 1.0 and got["A"].key_contributions == ["M1", "M2"]
    assert got["A"].summary == "Proposes M1, M2; evaluated on Cora; 3 evidence-backed claim(s) extracted."
    assert got["B"].novelty_score is None and got["A"].novelty_score is not None
    assert got["D"].summary.startswith("0 evidence-backed claim(s) extracted; no methods")
    (single,) = analysis.paper_analysis(knowledge(spark, [{"t": "A", "m": ["UniqueMethodXYZ"]}])).collect()
    assert (single.novelty_score, single.impact_score) == (1.0, 0.0)


def test_missing_citations(spark):
    def found(cites):
        k = knowledge(spark, [{"t": "Origin", "d": ["Cora"]}, {"t": "Reusing", "d": ["Cora"], "cites": cites}])
        return gaps.missing_citations(analysis.paper_concepts(k), analysis.paper_cites(k)).collect()

    (one,) = found(None)
    assert (one.citing_paper_title, one.likely_source_paper, one.concept) == ("Reusing", "Origin", "Cora")
    assert found(["Origin"]) == []


def test_review(spark):
    def text(rows):
        lines = report.review_lines("q", knowledge(spark, rows)).orderBy("block", "ord", "item_key", "item").collect()
        return "\n".join(r.line for r in lines)

    rows = [{"t": "GraphMix: A", "m": ["GraphMix"], "d": ["Cora", "Citeseer"], "c": ["1% Cora", "b", "c", "d"]},
            {"t": "Attention", "m": ["GAT"], "d": ["Cora", "PubMed"], "c": []}]
    assert text(rows) == (
        '# Literature Review: q\n\nThis review covers 2 paper(s) discovered and analyzed for the query "q".\n\n'
        "## Methods Identified\n- GAT\n- GraphMix\n\n## Datasets Used\n- Citeseer\n- Cora\n- PubMed\n\n"
        "## Per-Paper Summary\n### GraphMix: A\n**Proposes:** GraphMix\n**Evaluated on:** Cora, Citeseer\n"
        "**Key claims:**\n- 1% Cora\n- b\n- c\n\n### Attention\n**Proposes:** GAT\n**Evaluated on:** Cora, PubMed\n")
    assert text([]).endswith("so no review could be generated.")


def test_knowledge_summary_uses_resolved_names(spark):
    raw = spark.createDataFrame(
        [("a", 0, 1, "dataset", "CORA", None, "heuristic", 0.6), ("a", 0, 0, "method", "M", None, "heuristic", 0.6),
         ("a", 0, 2, "claim", "A — claim 1", "5% on Cora", "heuristic", 0.6)], schemas.RAW_ENTITIES)
    rels = spark.createDataFrame([("a", 0, "A", "M", "proposes", None, 0.6)], schemas.RAW_RELATIONSHIPS)
    papers = spark.createDataFrame([("a", "A", None, 0), ("b", "B", None, 1)],
                                   "paper_id STRING, title STRING, published_at TIMESTAMP, ord BIGINT")
    cites = spark.createDataFrame([("a", "r", "B")], "paper_id STRING, reference_id STRING, cited_title STRING")
    from folioscope.operators.graph import resolve_entities

    first = raw.withColumn("name", F.initcap("name")).withColumn("paper_ord", F.lit(-1).cast("bigint"))
    entities = resolve_entities(raw.unionByName(first))
    got = {r.paper_id: r for r in analysis.knowledge_summary(papers, raw, rels, cites, entities).collect()}
    assert got["a"].datasets == ["Cora"] and got["a"].claims == ["5% on Cora"] and got["a"].cites == ["B"]
    assert (got["a"].entities_created, got["a"].relationships_created) == (3, 2)
    assert got["b"].methods == [] and got["b"].entities_created == 0


def test_order_and_partitions_do_not_matter(spark):
    rows = random_papers(4, 30)
    k = knowledge(spark, rows)
    base = sorted(map(tuple, analysis.paper_analysis(k).collect()))
    shuffled = k.orderBy(F.rand(3)).repartition(7)
    assert sorted(map(tuple, analysis.paper_analysis(shuffled).collect())) == base
