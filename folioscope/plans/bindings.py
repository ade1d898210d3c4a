"""Operators bound to the driver tables, one DataFrame per registered query."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.functions import text as T
from folioscope.operators import (
    analysis,
    citations,
    extraction,
    figures,
    gaps,
    graph,
    novelty,
    overlap,
    report,
    retrieval,
    structure,
)
from folioscope.plans.oracle import CUES, METRIC_WORDS, NAME_WORD, NUMBER, PHRASE, WORDS
from folioscope.session import checkpoint_dir, settle
from folioscope.sources import catalog, feeds, responses
from folioscope.sources.store import PaperStore
from folioscope.sources.tables import spread, table
from folioscope.streaming import admission, requests

HEADING = [("sentence", r"^[^.!?]*[.!?]$")]


# ---- inputs -------------------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def doc_texts(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", "text")


def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        F.col("doc_id").alias("paper_id"), F.lit(0).alias("page_no"), "text"
    )


def turn_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("paper_id"), F.col("turn").cast("int").alias("page_no"), "text"
    )


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def order_knowledge(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as papers: parts on finished lines are methods, on open lines
    datasets; every line claims its discount."""
    # keys and numbers are gathered; names are made of them afterwards, for the lists that are asked for
    line = F.struct(
        "l_linenumber", "l_partkey", "l_linestatus", F.round(F.col("l_discount") * 100).cast("int").alias("percent")
    )
    lines = lineitem(spark, sf).groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    part = lambda e: F.concat(F.lit("part "), e["l_partkey"].cast("string"))
    claim = lambda e: F.concat(part(e), F.lit(" gets "), e["percent"].cast("string"), F.lit("% off"))

    def listed(v, status: str | None = None) -> Column:
        kept = F.col("lines") if status is None else F.filter("lines", lambda e: e["l_linestatus"] == status)
        pairs = F.transform(kept, lambda e: F.struct(e["l_linenumber"].alias("l_linenumber"), v(e).alias("v")))
        return F.transform(F.array_sort(pairs), lambda e: e["v"])

    lines = lines.select(
        "l_orderkey", listed(part, "F").alias("methods"), listed(part, "O").alias("datasets"),
        listed(part).alias("parts"), listed(claim).alias("claims"),
    )
    empty = lambda c: T.or_empty(F.col(c)).alias(c)
    return (
        table(spark, sf, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("paper_id"),
            F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("paper_title"),
            F.year("o_orderdate").alias("year"),
            F.col("o_orderkey").alias("ord"),
            "o_orderpriority",
            empty("methods"),
            empty("datasets"),
            empty("parts"),
            empty("claims"),
        )
    )


def order_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as papers, parts as their datasets, one row per line."""
    return lineitem(spark, sf).select(
        F.col("l_orderkey").alias("paper_id"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("paper_title"),
        F.col("l_orderkey").alias("ord"),
        F.lit("dataset").alias("kind"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("concept"),
    )


def brand_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as papers, part names as their methods, one row per distinct pair."""
    return (
        table(spark, sf, "part")
        .select(
            F.col("p_brand").alias("paper_title"),
            F.lit("method").alias("kind"),
            F.col("p_name").alias("concept"),
        )
        .distinct()
    )


def brand_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities ordered of each brand over the order years."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year")
    )
    return (
        lineitem(spark, sf)
        .join(parts, "l_partkey")
        .join(orders, "l_orderkey")
        .select(
            F.col("p_brand").alias("dataset"),
            "year",
            F.col("l_orderkey").alias("ord"),
            F.col("l_linenumber").alias("claim_no"),
            (F.col("l_partkey") * 64 + F.col("l_quantity").cast("bigint")).alias("dataset_no"),
            F.col("l_quantity").alias("value"),
        )
    )


def part_figures(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem(spark, sf).select(
        F.col("l_partkey").alias("dataset"),
        F.col("l_quantity").alias("value"),
        F.col("l_orderkey").cast("string").alias("paper_title"),
        "l_linenumber",
    )


def event_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests: an error event is a server error."""
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "ts",
        F.lit("GET").alias("method"),
        F.col("event_type").alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("duration"),
    )


def stamp(c: str) -> Column:
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(c)


# ---- text ---------------------------------------------------------------------


def clean_text(spark, sf):
    c = T.clean_text(F.col("text"))
    return doc_texts(spark, sf).select("doc_id", F.length(c).alias("n"), F.md5(c).alias("digest"))


def normalize_title(spark, sf):
    c = T.normalize_title(F.col("text"))
    return doc_texts(spark, sf).select("doc_id", F.length(c).alias("n"), F.md5(c).alias("digest"))


def tokenize_counts(spark, sf):
    tokens = doc_texts(spark, sf).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return tokens.select(
        "doc_id",
        F.size("t").alias("tokens"),
        F.size(F.array_distinct("t")).alias("terms"),
        F.md5(F.array_join("t", " ")).alias("digest"),
    )


def vocab_match(spark, sf):
    docs = doc_texts(spark, sf)
    first = extraction.vocab_match(docs, "text", WORDS).withColumn("vocabulary", F.lit("dataset"))
    second = extraction.vocab_match(docs, "text", METRIC_WORDS).withColumn("vocabulary", F.lit("metric"))
    return first.unionByName(second).select("doc_id", "vocabulary", "name")


def match_names(spark, sf):
    """Names of one word and of two with a blank between, as benchmark items and parts have them."""
    items = table(spark, sf, "benchmark").select(F.split("text", " ").alias("w"))
    plain = lambda w: w.rlike("^[A-Za-z]+$")
    pairs = F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.when(
        plain(a) & F.coalesce(plain(b), F.lit(False)), F.concat_ws(" ", a, b)))
    names = items.select(F.explode(F.concat(F.filter("w", plain), F.array_compact(pairs))).alias("name"))
    parts = table(spark, sf, "part").select(F.col("p_name").alias("name"))
    return extraction.match_names(doc_texts(spark, sf), "text", names.union(parts))


def cue_names(spark, sf):
    return extraction.cue_names(doc_texts(spark, sf), "text", CUES, NAME_WORD).select(
        "doc_id", "pos", "name"
    )


def claim_sentences(spark, sf):
    return extraction.claim_sentences(doc_texts(spark, sf), "text", NUMBER).select(
        "doc_id", "pos", "sentence"
    )


def document_sections(spark, sf):
    """Every document as two sections of one paper."""
    docs = documents(spark, sf)
    kinds = F.array(
        F.struct(F.lit(0).alias("i"), F.lit("methodology").alias("k")),
        F.struct(F.lit(1).alias("i"), F.lit("results").alias("k")),
    )
    return docs.select(
        F.col("doc_id").alias("paper_id"), F.explode(kinds).alias("s"), F.col("text").alias("content")
    ).select(
        "paper_id", F.col("s.i").alias("order_index"), F.col("s.k").alias("section_type"), "content"
    )


def document_papers(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("paper_id"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("doc_id").alias("ord"),
    )


def extract_knowledge(spark, sf):
    facts = extraction.extract_facts(
        document_sections(spark, sf),
        document_papers(spark, sf),
        datasets=WORDS,
        metrics=METRIC_WORDS,
        cues=CUES,
        name_word=NAME_WORD,
        number_pattern=NUMBER,
    )
    return facts.select(
        "paper_id", "ord", "entity_type", "relationship_type", "name", "description", "evidence",
        "confidence",
    )


# ---- structure ----------------------------------------------------------------


def classify_lines(spark, sf):
    return structure.classify_lines(document_pages(spark, sf), HEADING)


def segment_sections(spark, sf):
    return structure.segment_sections(document_pages(spark, sf), HEADING)


def segment_turns(spark, sf):
    return structure.segment_sections(turn_pages(spark, sf), HEADING)


def section_previews(spark, sf):
    sections = document_pages(spark, sf).select(
        "paper_id", F.lit("body").alias("section_type"), F.col("text").alias("content")
    )
    return report.section_previews(sections).select("paper_id", "preview")


def split_references(spark, sf):
    """A numbered reference list per order, written from its lines, split again."""
    entry = F.concat(
        F.lit("["), F.col("l_linenumber").cast("string"), F.lit("] Part P"),
        F.col("l_partkey").cast("string"), F.lit(" from supplier S"), F.col("l_suppkey").cast("string"),
        F.lit(". "), F.year("l_shipdate").cast("string"), F.lit("."),
    )
    lists = (
        lineitem(spark, sf)
        .groupBy("l_orderkey")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("l_linenumber", entry.alias("e")))),
                    lambda x: x["e"],
                ),
                "\n",
            ).alias("content")
        )
        .select(
            F.col("l_orderkey").alias("paper_id"),
            F.lit("references").alias("section_type"),
            F.lit(0).alias("order_index"),
            "content",
        )
    )
    return structure.split_references(lists).select(
        "paper_id", "order_index", "raw_text", "parsed_year"
    )


def assemble_turns(spark, sf):
    return structure.assemble_pages(turn_pages(spark, sf))


# ---- retrieval ----------------------------------------------------------------


def term_stats(spark, sf):
    return retrieval.term_stats(doc_texts(spark, sf))


def term_idf(spark, sf):
    return retrieval.term_idf(doc_texts(spark, sf)).withColumn("idf", F.round("idf", 6))


def bm25_topk(spark, sf):
    query = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(PHRASE).alias("text"))
    hits = retrieval.bm25_over_documents(doc_texts(spark, sf), query)
    papers = table(spark, sf, "documents").withColumnRenamed("doc_id", "paper_id")
    return retrieval.hydrate(hits, papers, ["lang", "source"]).select(
        "rank", "doc_id", "lang", "source", "score"
    )


def search_corpus(spark, sf):
    """Documents as papers; those labelled good have been extracted."""
    status = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("good"))
    papers = table(spark, sf, "documents").join(status, "doc_id", "left").select(
        F.col("doc_id").alias("paper_id"), F.col("source").alias("title"), F.col("lang").alias("abstract"),
        F.col("text").alias("full_text"), F.when(F.col("good") == 1, "completed").otherwise("failed").alias("extraction_status"),
    )
    return retrieval.search_corpus(papers, benchmark_queries(spark, sf))


def bm25_batch_topk(spark, sf):
    return retrieval.bm25_over_documents(doc_texts(spark, sf), benchmark_queries(spark, sf))


def bm25_bounded(spark, sf):
    """The index of all documents, stored; every benchmark item asks it."""
    folder = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/index-{uuid.uuid4().hex}"
    retrieval.build_index(doc_texts(spark, sf)).save(path)
    return retrieval.bm25_bounded(retrieval.Index.load(spark, path), benchmark_queries(spark, sf))


def rrf_fusion(spark, sf):
    """Whole lists are fused: a document far down in one of them keeps its share of it."""
    queries = benchmark_queries(spark, sf)
    index = retrieval.restricted_index(doc_texts(spark, sf), queries)
    lists = [
        retrieval.bm25_search(index, queries, None, k1, b).withColumn("list_id", F.lit(i))
        for i, (k1, b) in enumerate([(1.5, 0.75), (1.2, 0.3)])
    ]
    return retrieval.rrf(lists[0].unionByName(lists[1]), by=["query_id"]).select(
        "query_id", "doc_id", "score"
    )


# ---- graph --------------------------------------------------------------------


def word_mentions(spark, sf):
    words = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), F.lit(0))
    return documents(spark, sf).select("doc_id", "lang", F.posexplode(words).alias("pos", "name"))


def resolve_entities(spark, sf):
    raw = word_mentions(spark, sf).select(
        F.col("doc_id").alias("paper_id"),
        F.col("doc_id").alias("paper_ord"),
        F.col("pos").alias("ord"),
        F.concat(F.lit("word-"), "lang").alias("entity_type"),
        "name",
        F.lit(None).cast("string").alias("description"),
        F.lit("heuristic").alias("extraction_method"),
        F.lit(0.6).alias("confidence"),
    )
    return graph.resolve_entities(raw).select("entity_id", "entity_type", "normalized_name", "name")


def resolve_authors(spark, sf):
    return catalog.resolve_authors(word_mentions(spark, sf), ["doc_id", "pos"])


def supplier_papers(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("paper_id"),
        F.col("s_name").alias("title"),
        F.lit(None).cast("string").alias("abstract"),
        F.col("s_suppkey").alias("ord"),
    )


def supplied_parts(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    return lineitem(spark, sf).join(parts, "l_partkey")


def resolve_edges(spark, sf):
    lines = supplied_parts(spark, sf)
    raw_entities = lines.select(
        F.col("l_suppkey").alias("paper_id"),
        F.col("l_partkey").alias("ord"),
        F.when(F.col("p_size") > 25, "method").otherwise("dataset").alias("entity_type"),
        F.col("p_name").alias("name"),
    ).distinct()
    raw_relationships = lines.select(
        F.col("l_suppkey").alias("paper_id"),
        F.col("l_linenumber").alias("ord"),
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("source_name"),
        # seventh lines name something that is no entity: their edges dangle
        F.when(F.col("l_linenumber") == 7, F.concat(F.upper("p_name"), F.lit(" UNKNOWN"))).otherwise(F.upper("p_name")).alias("target_name"),
        F.lit("evaluated_on").alias("relationship_type"),
        F.col("l_orderkey").cast("string").alias("evidence"),
        F.lit(0.6).alias("confidence"),
    )
    return graph.resolve_edges(raw_relationships, raw_entities, supplier_papers(spark, sf))


def supplier_graph(spark, sf):
    """Suppliers as papers; nations and parts as shared nodes; a claim per supplier."""
    suppliers = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    claim = F.concat(F.col("s_name"), F.lit(" trades in "), F.col("n_name"))
    node = lambda kind, name, source: F.struct(
        F.lit(kind).alias("entity_type"), name.alias("name"), source.cast("bigint").alias("source_paper_id")
    )
    none = F.lit(None)
    kinds = suppliers.select(
        F.explode(
            F.array(
                node("paper", F.col("s_name"), F.col("s_suppkey")),
                node("claim", claim, F.col("s_suppkey")),
                node("concept", F.col("n_name"), none),
            )
        ).alias("n")
    ).select("n.*")
    parts = table(spark, sf, "part").select(
        F.lit("dataset").alias("entity_type"), F.col("p_name").alias("name"),
        F.lit(None).cast("bigint").alias("source_paper_id"),
    )
    entities = kinds.unionByName(parts).distinct().select(
        graph.entity_id(F.col("entity_type"), F.col("name")).alias("entity_id"),
        "entity_type", "name", "source_paper_id", F.lit(1.0).alias("confidence"),
    )
    own = graph.paper_entity_id(F.col("s_name"))
    facts = suppliers.select(
        own.alias("source_entity_id"),
        F.explode(
            F.array(
                F.struct(graph.entity_id(F.lit("claim"), claim).alias("t"), claim.alias("e")),
                F.struct(graph.entity_id(F.lit("concept"), F.col("n_name")).alias("t"), F.col("n_name").alias("e")),
            )
        ).alias("x"),
    ).select(
        "source_entity_id", F.col("x.t").alias("target_entity_id"),
        F.lit("mentions").alias("relationship_type"), F.col("x.e").alias("evidence"),
    )
    supplies = supplied_parts(spark, sf).select("l_suppkey", "p_name").distinct()
    uses = supplies.join(
        table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    ).select(
        own.alias("source_entity_id"),
        graph.entity_id(F.lit("dataset"), F.col("p_name")).alias("target_entity_id"),
        F.lit("evaluated_on").alias("relationship_type"),
        F.col("p_name").alias("evidence"),
    )
    return entities, facts.unionByName(uses)


def _subgraph(spark, sf):
    entities, relationships = supplier_graph(spark, sf)
    papers = supplier_papers(spark, sf)
    return graph.paper_subgraph(entities, relationships, papers, papers.select("paper_id"))


def paper_subgraph(spark, sf):
    return _subgraph(spark, sf)[1]


def paper_subgraph_nodes(spark, sf):
    return _subgraph(spark, sf)[0]


def nodes_by_type(spark, sf):
    return graph.nodes_by_type(supplier_graph(spark, sf)[0])


def graph_edges_merged(spark, sf):
    edges = lineitem(spark, sf).select(
        F.col("l_suppkey").alias("source_entity_id"),
        F.col("l_partkey").alias("target_entity_id"),
        F.when(F.col("l_returnflag") == "R", "mentions").otherwise("uses_dataset").alias("relationship_type"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("evidence"),
        F.col("l_discount").alias("confidence"),
        F.struct("l_orderkey", "l_linenumber", "l_discount").alias("at"),
    )
    return graph.merge_edges(edges, "at")


def _document_citations(spark, sf):
    references = documents(spark, sf).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paper_id"),
        F.col("doc_id").alias("reference_id"),
        F.col("text").alias("raw_text"),
    )
    titles = table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("paper_id"),
        F.col("text").alias("title"),
    )
    return citations.citation_match(references, titles)


def citation_match(spark, sf):
    return _document_citations(spark, sf).select(
        "reference_id", "cited_paper_id", "match_confidence"
    )


def citation_edges(spark, sf):
    citing = document_papers(spark, sf).select(
        F.concat(F.lit("d"), F.col("paper_id").cast("string")).alias("paper_id"), "title"
    )
    return graph.citation_edges(_document_citations(spark, sf), citing)


def edge_union(spark, sf):
    """All edges of the graph: those that extraction named and those of citations."""
    columns = ["paper_id", "source_entity_id", "target_entity_id", "relationship_type", "evidence", "confidence"]
    named = resolve_edges(spark, sf).withColumn("paper_id", F.col("paper_id").cast("string"))
    return named.select(*columns).unionByName(citation_edges(spark, sf).select(*columns))


# ---- analyses -----------------------------------------------------------------


def claim_figures(spark, sf):
    knowledge = order_knowledge(spark, sf).withColumn("datasets", F.col("parts"))
    return figures.claim_figures(knowledge).select(
        "paper_id", "claim_no", "dataset_no", "dataset", "value", "claim"
    )


def contradictions(spark, sf):
    return figures.contradictions(part_figures(spark, sf), min_spread=49.0)


def contradiction_figures(spark, sf):
    rows = part_figures(spark, sf)
    return figures.contradiction_figures(rows, figures.contradictions(rows, min_spread=49.0))


def gap_underexplored(spark, sf):
    listed = lineitem(spark, sf).select(
        F.lit("dataset").alias("kind"),
        F.concat_ws(
            "/", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
        ).alias("concept"),
    )
    return gaps.underexplored(listed)


def gap_unevaluated(spark, sf):
    knowledge = order_knowledge(spark, sf).select(
        "paper_title", F.array("o_orderpriority").alias("methods"), F.col("parts").alias("datasets")
    )
    return gaps.unevaluated(knowledge)


def benchmark_timeline(spark, sf):
    return figures.timelines(brand_figures(spark, sf))


def timeline_points(spark, sf):
    return figures.timeline_points(brand_figures(spark, sf)).drop("dataset_no")


def novelty_overlap(spark, sf):
    return novelty.novelty_overlap(brand_methods(spark, sf))


def novelty_score(spark, sf):
    return novelty.novelty(brand_methods(spark, sf))


def low_novelty(spark, sf):
    return novelty.low_novelty(novelty.novelty(brand_methods(spark, sf)))


def impact_score(spark, sf):
    knowledge = settle(order_knowledge(spark, sf).drop("o_orderpriority", "parts", "claims"))
    return overlap.impact(
        analysis.paper_concepts(knowledge), knowledge.select("paper_id", "paper_title")
    )


def paper_analysis(spark, sf):
    knowledge = settle(order_knowledge(spark, sf).drop("o_orderpriority", "parts"))
    return analysis.paper_analysis(knowledge).withColumn(
        "key_contributions", F.array_join("key_contributions", ",")
    )


def missing_citations(spark, sf):
    """Every order cites the first order of its customer."""
    orders = table(spark, sf, "orders")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))
    cites = orders.join(first, "o_custkey").select(
        F.col("o_orderkey").alias("paper_id"),
        F.concat(F.lit("order "), F.col("first_order").cast("string")).alias("cited_title"),
    )
    return gaps.missing_citations(order_parts(spark, sf), cites).select(
        "paper_id", "concept", "likely_source_paper", "reason"
    )


def recommend_topk(spark, sf):
    return overlap.recommend(order_parts(spark, sf))


def recommend_full(spark, sf):
    """Every order, with the names it shares with each recommended one."""
    concepts = order_parts(spark, sf)
    named = overlap.shared_concepts(overlap.recommend(concepts), concepts)
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"))
    return overlap.with_empty(named, orders).withColumn("shared_concepts", F.array_join("shared_concepts", ","))


def recommend_suppliers(spark, sf):
    """Orders as papers, suppliers as their concepts."""
    rows = lineitem(spark, sf).select(
        F.col("l_orderkey").alias("paper_id"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("paper_title"),
        F.col("l_orderkey").alias("ord"),
        F.lit("dataset").alias("kind"),
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("concept"),
    )
    return overlap.recommend(rows)


def _customer_concepts(spark, sf, *names: Column) -> DataFrame:
    """Customers as papers, two of a title; each line gives one of the names."""
    title = F.concat(F.lit("customer "), F.floor(F.col("c_custkey") / 2).cast("string"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("paper_id"), title.alias("paper_title"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("paper_id"))
    home = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return lineitem(spark, sf).join(home, "l_suppkey").join(orders, "l_orderkey").join(people, "paper_id").select(
        "paper_id", "paper_title", F.col("paper_id").alias("ord"),
        F.when(F.col("l_linestatus") == "F", "method").otherwise("dataset").alias("kind"),
        F.explode(F.array(*names)).alias("concept"),
    )


def recommend_customers(spark, sf):
    """Parts, and return flags that nearly all customers share."""
    part = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    return overlap.recommend(_customer_concepts(spark, sf, part, F.concat(F.lit("flag "), "l_returnflag")))


def impact_customers(spark, sf):
    """Nations of suppliers: a customer has dozens of these popular concepts."""
    nation = F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))
    rows = _customer_concepts(spark, sf, nation)
    papers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("paper_id"), F.concat(F.lit("customer "), F.floor(F.col("c_custkey") / 2).cast("string")).alias("paper_title"))
    return overlap.impact(rows, papers)


def knowledge_summary(spark, sf):
    lines = lineitem(spark, sf)
    part = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    raw_entities = lines.select(
        F.col("l_orderkey").alias("paper_id"),
        F.col("l_linenumber").alias("ord"),
        F.when(F.col("l_linestatus") == "F", "method").otherwise("dataset").alias("entity_type"),
        part.alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.when(F.col("l_returnflag") == "R", "llm").otherwise("heuristic").alias("extraction_method"),
    )
    edges = lines.where(F.col("l_returnflag") != "N").select(F.col("l_orderkey").alias("paper_id"))
    papers = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("paper_id"),
        F.col("o_orderkey").cast("string").alias("title"),
        F.col("o_orderdate").alias("published_at"),
        F.col("o_orderkey").alias("ord"),
    )
    summary = analysis.knowledge_summary(papers, raw_entities, edges)
    return summary.select(
        "paper_id",
        "year",
        "entities_created",
        "relationships_created",
        "method_used",
        F.array_join("methods", ",").alias("methods"),
        F.array_join("datasets", ",").alias("datasets"),
    )


def review_lines(spark, sf):
    knowledge = settle(order_knowledge(spark, sf).drop("parts", "o_orderpriority"))
    return report.review_lines("orders", knowledge)


def run_totals(spark, sf):
    knowledge = settle(order_knowledge(spark, sf))
    return report.run_totals(
        discovered=knowledge,
        entities=analysis.paper_concepts(knowledge),
        figures=figures.claim_figures(knowledge.withColumn("datasets", F.col("parts"))),
    )


# ---- sources ------------------------------------------------------------------


def _blank(kind: str):
    return F.lit(None).cast(kind)


def unify_sources(spark, sf):
    def shape(df, source, key, title, abstract):
        return df.select(
            F.lit(source).alias("source"),
            F.col(key).cast("string").alias("source_id"),
            _blank("string").alias("arxiv_id"),
            title.alias("title"),
            abstract.alias("abstract"),
            F.array().cast("array<string>").alias("authors"),
            _blank("int").alias("year"),
            _blank("string").alias("venue"),
            _blank("int").alias("citation_count"),
            _blank("string").alias("pdf_url"),
        )

    loaders = {
        "documents": lambda: shape(table(spark, sf, "documents"), "documents", "doc_id", F.col("lang"), F.col("text")),
        "pages": lambda: shape(table(spark, sf, "pages"), "pages", "page_id", F.col("url"), F.col("html")),
        "benchmark": lambda: shape(table(spark, sf, "benchmark"), "benchmark", "item_id", F.lit(""), F.col("text")),
        "missing": lambda: table(spark, sf, "no_such_table"),
    }
    return catalog.unify(loaders).select(
        "source", "source_id", "title", F.md5("abstract").alias("digest")
    )


def search_payloads(spark, sf):
    """Documents written as search-response bodies, parsed back."""
    item = F.struct(
        F.col("doc_id").cast("string").alias("paperId"),
        F.concat(F.lit("  "), F.col("source"), F.lit("\n")).alias("title"),
        F.col("text").alias("abstract"),
        (F.lit(1900) + F.col("doc_id") % 120).cast("int").alias("year"),
        F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("venue"),
        F.col("n_chars").cast("int").alias("citationCount"),
        F.create_map(F.lit("ArXiv"), F.concat(F.lit("x."), F.col("doc_id").cast("string"))).alias("externalIds"),
        F.array(F.struct(F.col("lang").alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"),
    )
    bodies = documents(spark, sf).select(F.to_json(F.struct(F.array(item).alias("data"))).alias("body"))
    return feeds.parse_search_payloads(bodies, "body").select(
        "source_id", "title", F.md5("abstract").alias("digest"), "year", "venue", "citation_count",
        "arxiv_id", F.array_join("authors", ",").alias("authors"),
    )


def feed_entries(spark, sf):
    """Pages written as Atom entries, parsed back."""
    escaped = F.regexp_replace(
        F.regexp_replace(F.regexp_replace("url", "&", "&amp;"), "<", "&lt;"), ">", "&gt;"
    )
    xml = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/'),
        F.col("page_id").cast("string"),
        F.lit("v2/</id><published>2020-01-02T03:04:05Z</published><title> "),
        escaped,
        F.lit("\n</title><summary>"),
        escaped,
        F.lit("</summary><author><name>A  B</name></author><author><name></name></author>"
              '<category term="cs.LG"/></entry></feed>'),
    )
    bodies = spread(table(spark, sf, "pages"), "page_id").select(xml.alias("body"))
    return feeds.parse_feeds(bodies, "body").select(
        "arxiv_id", "title", "abstract", F.array_join("authors", ",").alias("authors"),
        F.year("published_at").alias("year"), F.array_join("categories", ",").alias("categories"), "pdf_url",
    )


def _event_responses(spark, sf):
    """Event properties as extraction responses; signups answer with prose, and
    clicks of two kinds go on after their object."""
    k = F.get_json_object("props", "$.k")
    answer = F.concat(
        F.lit('{"methods": [{"name": "k'), k, F.lit('", "description": "'), F.col("event_type"),
        F.lit('"}, {"name": ""}], "claims": [{"description": ""}, {"description": "value '), k,
        F.lit('"}]}'),
    )
    fenced = F.concat(F.lit("```json\n"), answer, F.lit("\n```"))
    odd = F.col("event_id") % 10
    return spread(table(spark, sf, "events"), "event_id").select(
        F.col("event_id").alias("paper_id"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"),
        F.col("event_id").alias("paper_ord"),
        F.when(F.col("event_type") == "signup", "no idea")
        .when((F.col("event_type") == "click") & (odd == 1), F.concat(answer, F.lit("] trailing prose")))
        .when((F.col("event_type") == "click") & (odd == 2), F.concat(answer, F.lit('] [{"x": 1}')))
        .when((F.col("event_type") == "click") & (odd == 3), F.concat(answer, F.lit(', "x": {}')))
        .otherwise(fenced).alias("response"),
        "value",
    )


_FACTS = ["paper_id", "ord", "entity_type", "relationship_type", "name", "description", "evidence",
          "extraction_method", "confidence"]


def parse_responses(spark, sf):
    return responses.parse_responses(_event_responses(spark, sf)).select(*_FACTS)


def coalesce_extractions(spark, sf):
    # read once: a condition on the parsed text would also move before the rows are spread
    answered = settle(responses.read_responses(_event_responses(spark, sf)))
    value = F.concat(F.lit("value "), F.col("value").cast("bigint").cast("string"))
    heuristic = answered.select(
        "paper_id", "title", "paper_ord", F.lit(0).alias("ord"),
        F.lit("metric").alias("entity_type"), F.lit("mentions").alias("relationship_type"),
        value.alias("name"), F.lit(None).cast("string").alias("description"), value.alias("evidence"),
        F.lit("heuristic").alias("extraction_method"), F.lit(0.6).alias("confidence"),
    )
    merged = responses.coalesce_extractions(
        responses.parse_responses(answered), heuristic, responses.parsed_papers(answered)
    )
    return merged.select(*_FACTS)


def _labelled(spark, sf):
    """Documents with an ingest status from their label."""
    labels = table(spark, sf, "labels")
    status = (
        F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "failed").otherwise("not_started")
    )
    return (
        table(spark, sf, "documents")
        .join(labels, "doc_id", "left")
        .select(F.col("doc_id").alias("arxiv_id"), "lang", status.alias("extraction_status"))
    )


def ingest_todo(spark, sf):
    requested = table(spark, sf, "documents").select(F.col("doc_id").alias("arxiv_id"), "source")
    return catalog.plan_ingest(requested, _labelled(spark, sf))


def upsert_papers(spark, sf):
    papers = _labelled(spark, sf).where(F.col("extraction_status") != "not_started")
    incoming = table(spark, sf, "documents").select(
        F.col("doc_id").alias("arxiv_id"),
        F.upper("lang").alias("lang"),
        F.lit("downloading").alias("extraction_status"),
    )
    return catalog.upsert_papers(papers, incoming)


def upsert_store(spark, sf):
    """A store of labelled documents, their lines as sections, takes in a run of every
    second document, of which every sixth now has no lines."""
    folder = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    store = PaperStore(f"{folder.rstrip('/')}/store-{uuid.uuid4().hex}", shards=16)
    first = _labelled(spark, sf).where(F.col("extraction_status") != "not_started")
    text = table(spark, sf, "documents").select(F.col("doc_id").alias("arxiv_id"), F.split("text", "\n").alias("lines"))
    line = text.select("arxiv_id", F.posexplode("lines").alias("order_index", "content"))
    short = line.select("arxiv_id", F.col("order_index").alias("order_index"), F.md5("content").alias("content"))
    refs = text.select("arxiv_id", F.lit(0).alias("order_index"), F.element_at("lines", -1).alias("raw_text"))
    store.upsert(first, short, refs.withColumn("raw_text", F.md5("raw_text")))
    again = table(spark, sf, "documents").where("doc_id % 2 = 0").select(
        F.col("doc_id").alias("arxiv_id"), F.upper("lang").alias("lang"), F.lit("completed").alias("extraction_status"))
    store.upsert(
        again, short.where("arxiv_id % 6 != 0").withColumn("content", F.concat(F.lit("new "), "content")),
        refs.withColumn("raw_text", F.lit("new")),
    )
    sections = store.table(short, "sections").groupBy("arxiv_id").agg(
        F.count(F.lit(1)).alias("sections"), F.md5(F.concat_ws(",", F.transform(
            F.array_sort(F.collect_list(F.struct("order_index", "content"))), lambda s: s["content"]))).alias("digest"))
    cited = store.table(refs, "references").groupBy("arxiv_id").agg(F.max("raw_text").alias("reference"))
    return store.table(first, "papers").join(sections, "arxiv_id", "left").join(cited, "arxiv_id", "left")


def status_funnel(spark, sf):
    return report.status_funnel(_labelled(spark, sf))


def paper_detail(spark, sf):
    """Orders as papers; clerks of a line as authors, lines as sections and references."""
    lines = lineitem(spark, sf)
    papers = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("title")
    )
    paper_authors = lines.select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"),
        F.col("l_linenumber").alias("author_order"),
    )
    authors = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name")
    )
    sections = lines.select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("order_index"),
        F.lit("line").alias("heading"), F.lit("body").alias("section_type"),
        F.lit(0).alias("page_start"), F.lit(0).alias("page_end"),
        F.col("l_returnflag").alias("content"),
    )
    references = lines.select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("order_index"),
        F.col("l_partkey").cast("string").alias("raw_text"), F.year("l_shipdate").alias("parsed_year"),
    )
    detail = report.paper_detail(papers, paper_authors, authors, sections, references)
    return detail.select(
        "paper_id",
        "title",
        F.array_join("authors", ";").alias("authors"),
        F.array_join("sections.content", ";").alias("sections"),
        F.array_join(
            F.transform(
                "references", lambda r: F.concat_ws("@", r["raw_text"], r["parsed_year"].cast("string"))
            ),
            ";",
        ).alias("references"),
    )


def paper_cards(spark, sf):
    return report.paper_cards(
        order_knowledge(spark, sf).select("paper_id", F.col("parts").alias("authors"))
    ).select("paper_id", "author_line")


def list_papers(spark, sf):
    papers = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("paper_id"), F.col("o_orderdate").alias("created_at"), "o_orderstatus"
    )
    return report.list_papers(papers, 50, 25).select(
        "paper_id", stamp("created_at"), "o_orderstatus"
    )


# ---- request streams ----------------------------------------------------------


def request_counts(spark, sf):
    return requests.request_counts(event_requests(spark, sf))


def request_latency(spark, sf):
    return requests.request_latency(event_requests(spark, sf)).withColumn(
        "total_seconds", F.round("total_seconds", 4)
    )


def status_breakdown(spark, sf):
    return requests.status_breakdown(event_requests(spark, sf))


def _windows(df, *values):
    return df.select(
        stamp("window_start"), stamp("window_end"),
        *[c for c in df.columns if c not in ("window_start", "window_end", *values)],
        *[F.round(v, 6).alias(v) for v in values],
    )


def request_rate_5m(spark, sf):
    return _windows(requests.request_rate(event_requests(spark, sf)), "rate")


def error_rate_5m(spark, sf):
    return _windows(requests.error_rate(event_requests(spark, sf)), "rate")


def latency_avg_5m(spark, sf):
    return _windows(requests.latency_average(event_requests(spark, sf)), "latency")


def requests_24h(spark, sf):
    return _windows(requests.requests_per_day(event_requests(spark, sf)))


def token_bucket(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    admitted = admission.admit(events, "user_id", "ts", 2, 1 / 7200, tie=["event_id"])
    return admitted.select(
        "event_id", "user_id", F.col("allowed").cast("int").alias("allowed"),
        F.round("remaining", 4).alias("remaining"),
    )


QUERIES = {
    f.__name__: f
    for f in [
        clean_text, normalize_title, tokenize_counts, vocab_match, match_names, cue_names, claim_sentences,
        extract_knowledge, classify_lines, segment_sections, segment_turns, section_previews,
        split_references, assemble_turns, term_stats, term_idf, bm25_topk, search_corpus, bm25_batch_topk, bm25_bounded,
        rrf_fusion, resolve_entities, resolve_authors, resolve_edges, edge_union, paper_subgraph,
        paper_subgraph_nodes, nodes_by_type, graph_edges_merged, citation_match, citation_edges,
        claim_figures, contradictions, contradiction_figures, gap_underexplored, gap_unevaluated,
        benchmark_timeline, timeline_points, novelty_overlap, novelty_score, low_novelty,
        impact_score, paper_analysis, missing_citations, recommend_topk, recommend_full,
        recommend_suppliers, recommend_customers, impact_customers, knowledge_summary,
        review_lines, run_totals, unify_sources, search_payloads, feed_entries, parse_responses,
        coalesce_extractions, ingest_todo, upsert_papers, upsert_store, status_funnel, paper_detail, paper_cards,
        list_papers, request_counts, request_latency, status_breakdown, request_rate_5m,
        error_rate_5m, latency_avg_5m, requests_24h, token_bucket,
    ]
}
