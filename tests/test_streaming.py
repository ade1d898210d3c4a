import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators.ordering import enumerated, numbered, running_total
from folioscope.plans.corpus import run_corpus
from folioscope.streaming import requests
from folioscope.streaming.admission import AdmissionStream, admit
from folioscope.streaming.refresh import CorpusRefresher

T0 = dt.datetime(2024, 1, 1)


def sec(s):
    return T0 + dt.timedelta(seconds=s)


def request_rows():
    rng = random.Random(1)
    return [(sec(rng.randint(0, 3000)), "GET", rng.choice(["/a", "/b"]), rng.choice([200, 502]), float(rng.randint(1, 5)))
            for _ in range(200)]


def test_request_metrics(spark):
    rows = [(sec(0), "GET", "/p", 200, 1.0), (sec(1), "GET", "/p", 502, 2.0)]
    df = spark.createDataFrame(rows, schemas.REQUESTS)
    assert {tuple(r) for r in requests.request_counts(df).collect()} == {("GET", "/p", 200, 1), ("GET", "/p", 502, 1)}
    (latency,) = requests.request_latency(df).collect()
    assert (latency.requests, latency.total_seconds, latency.max_seconds) == (2, 3.0, 2.0)
    assert {r.rate for r in requests.error_rate(df).collect()} == {1 / 300}


@pytest.mark.parametrize("name", ["request_counts", "request_rate"])
def test_stream_equals_batch(spark, tmp_path, name):
    operator = getattr(requests, name)
    rows = request_rows()
    spark.createDataFrame(rows, schemas.REQUESTS).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.REQUESTS).option("maxFilesPerTrigger", 5).parquet(str(tmp_path / "in"))
    query = (operator(stream).writeStream.outputMode("complete").format("memory").queryName(f"out_{name}")
             .option("checkpointLocation", str(tmp_path / "cp")).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(map(tuple, spark.table(f"out_{name}").collect()))
    assert got == sorted(map(tuple, operator(spark.createDataFrame(rows, schemas.REQUESTS)).collect()))


def bucket(rows, capacity, rate, cost=1.0):
    state, out = {}, {}
    for key, ts, i in sorted(rows):
        tokens, last = state.get(key, (float(capacity), ts))
        tokens = min(capacity, tokens + max(0.0, (ts - last).total_seconds()) * rate)
        out[i] = tokens >= cost
        state[key] = (tokens - cost if out[i] else tokens, ts)
    return out


def events(spark, rows):
    return spark.createDataFrame(rows, "key STRING, ts TIMESTAMP, event_id BIGINT")


def test_bucket_facts(spark):
    rows = [("u", sec(0), 0), ("u", sec(0), 1), ("u", sec(0), 2), ("u", sec(1), 3), ("u", sec(1), 4), ("v", sec(0), 5)]
    got = {r.event_id: r.allowed for r in admit(events(spark, rows), "key", "ts", 2, 1, tie=["event_id"]).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True}
    for capacity, rate in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            admit(events(spark, rows), "key", "ts", capacity, rate)


@pytest.mark.parametrize("slice_seconds", [3, 3600])
def test_bucket_equals_sequential_fold(spark, slice_seconds):
    rng = random.Random(2)
    rows, now = [], 0
    for i in range(400):
        now += rng.choice([0, 0, 1, 1, 2, 9])
        rows.append((rng.choice("aaab"), sec(now), i))
    for capacity, rate, cost in ((2, 0.5, 1.0), (3, 0.25, 1.5)):
        got = {r.event_id: r.allowed for r in admit(
            events(spark, rows), "key", "ts", capacity, rate, cost, ["event_id"], slice_seconds).collect()}
        assert got == bucket(rows, capacity, rate, cost)


def test_bucket_stream(spark, tmp_path):
    rng, now = random.Random(8), 0
    rows = [("a", sec(i // 2), i) for i in range(40)] + [("b", sec(i * 7), 100 + i) for i in range(10)]
    for i in range(600):  # a key with most events, with and without pauses
        now += rng.choice([0, 0, 0, 1, 9])
        rows.append(("hot", sec(now // 10), 200 + i))
    steps = sorted({r[1] for r in rows})
    for part in range(4):
        own = [r for r in rows if steps.index(r[1]) * 4 // len(steps) == part]
        events(spark, [*own, (None, own[0][1], -1)]).coalesce(1).write.parquet(str(tmp_path / f"in/part={part}"))
    stream = (spark.readStream.schema("key STRING, ts TIMESTAMP, event_id BIGINT").option("maxFilesPerTrigger", 1)
              .option("latestFirst", "false").parquet(str(tmp_path / "in/part=*")))
    target = AdmissionStream(str(tmp_path / "out"), "key", "ts", 3, 0.5, lateness_seconds=0, tie=["event_id"], slice_seconds=5)
    query = stream.writeStream.foreachBatch(target).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    batch = admit(events(spark, rows), "key", "ts", 3, 0.5, tie=["event_id"])
    told = lambda df: {(r.key, r.event_id, r.ts): (r.allowed, round(r.remaining, 9)) for r in df.collect()}
    assert target.decisions(spark).count() == len(rows)
    assert told(target.decisions(spark)) == told(batch)
    assert batch.where("allowed").count() == sum(bucket(rows, 3, 0.5).values())
    # the last batch once more; a bucket that is full again is not handed on
    target(spark.read.schema("key STRING, ts TIMESTAMP, event_id BIGINT").parquet(str(tmp_path / "in/part=3")), 3)
    assert told(target.decisions(spark)) == told(batch)
    left = {r.key for r in spark.read.parquet(str(tmp_path / "out/buckets/batch_id=3")).collect()}
    assert left == {"hot"}


def test_blocked_numbering_equals_window(spark):
    rng = random.Random(9)
    rows = [(rng.choice("xy"), i, rng.randint(0, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "k STRING, at INT, v INT").repartition(5)
    block = F.floor(F.col("at") / 16)
    got = {r.at: (r.n, r.total) for r in running_total(
        numbered(df, ["k"], ["at"], block, "n"), ["k"], ["at"], block, F.col("v"), "total").collect()}
    seen, want = {}, {}
    for k, at, v in rows:
        n, total = seen.get(k, (0, 0))
        want[at] = (n, total)
        seen[k] = (n + 1, total + v)
    assert got == want


PAPERS = [("p0", "Graph Mixing for Nodes", None, 0, [(0, "Abstract\nWe propose GraphMix."), (1, "Methodology\nWe propose GraphMix.\nResults\nIt gets 84.2% on Cora.")]),
          ("p1", "Attention over Everything", None, 1, [(0, "Methodology\nWe propose GraphMix.\nResults\nIt gets 60% on Cora.\nReferences\n[1] X. Graph mixing for nodes. 2017.\n[2] Y. Later Survey of Graphs. 2018.")]),
          ("p2", "Later Survey of Graphs", None, 2, [(0, "References\n1. Attention over everything, 2016")])]
SHAPE = "paper_id STRING, title STRING, abstract STRING, ord BIGINT, pages ARRAY<STRUCT<page_no: INT, text: STRING>>"


def run_whole(spark, folder):
    df = spark.createDataFrame(PAPERS, SHAPE)
    papers = df.drop("pages").withColumn("published_at", F.lit(None).cast("timestamp"))
    pages = df.select("paper_id", F.explode("pages").alias("p")).select("paper_id", "p.*")
    return run_corpus(spark, papers, pages, str(folder), "graphs")


def test_whole_corpus(spark, tmp_path):
    out = run_whole(spark, tmp_path)
    know = {r.paper_id: r for r in out["knowledge"].collect()}
    assert know["p0"].methods == ["GraphMix"] and know["p0"].datasets == ["Cora"]
    assert sorted(know["p1"].cites) == ["Graph Mixing for Nodes", "Later Survey of Graphs"]
    (clash,) = out["contradictions"].collect()
    assert clash.dataset == "Cora" and clash.spread == 24.2
    assert out["missing_citations"].count() == 0
    assert {(r.paper_id, r.recommended_id) for r in out["recommendations"].collect()} == {("p0", "p1"), ("p1", "p0"), ("p2", None)}
    assert out["analyses"].count() == 3 and out["review"].count() > 10
    assert {r.stage: r.rows for r in out["totals"].collect()}["discovered"] == 3


def test_refresh_equals_whole_run(spark, tmp_path):
    for i, row in enumerate(PAPERS):
        spark.createDataFrame([row], SHAPE).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = (spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*")))
    target = CorpusRefresher(str(tmp_path / "out"), shards=8)
    query = stream.writeStream.foreachBatch(target).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    whole = run_whole(spark, tmp_path / "whole")
    ids = lambda df: sorted(r.entity_id for r in df.collect())
    assert ids(target.table(spark, "entities")) == ids(whole["entities"])
    edges = lambda df: sorted((r.source_entity_id, r.target_entity_id, r.relationship_type) for r in df.collect())
    assert edges(target.table(spark, "relationships")) == edges(whole["relationships"])
    # a replay of the last batch leaves the tables as they are
    batches = [r.batch_id for r in target.table(spark, "papers").select("batch_id").distinct().collect()]
    last = target.table(spark, "papers").where(F.col("batch_id") == max(batches)).first().paper_id
    target(spark.createDataFrame([p for p in PAPERS if p[0] == last], SHAPE), max(batches))
    assert edges(target.table(spark, "relationships")) == edges(whole["relationships"])


def test_refresh_replaces_changed_papers(spark, tmp_path):
    """A new title and text of p0, an older version that comes late, a replay."""
    changed = ("p0", "Mixing Graphs Anew Today", None, 0, [(0, "Methodology\nWe propose NodeBlend.\nReferences\n[1] Z. Later Survey of Graphs. 2018.")])
    cites = ("p1", PAPERS[1][1], None, 1, [(0, PAPERS[1][4][0][1] + "\n[3] X. Mixing graphs anew today. 2019.")])
    target = CorpusRefresher(str(tmp_path / "out"), version="version", shards=8)
    shape = SHAPE + ", version BIGINT"
    of = lambda rows: spark.createDataFrame(rows, shape)
    batches = [of([(*PAPERS[0], 1), (*cites, 5)]), of([(*PAPERS[2], 1)]), of([(*PAPERS[0], 2), (*changed, 3)]), of([(*PAPERS[1], 4)])]
    for k in (0, 1, 2, 2, 3):
        target(batches[k], k)
    df = spark.createDataFrame([changed, cites, PAPERS[2]], SHAPE)
    papers = df.drop("pages").withColumn("published_at", F.lit(None).cast("timestamp"))
    whole = run_corpus(spark, papers, df.select("paper_id", F.explode("pages").alias("p")).select("paper_id", "p.*"), str(tmp_path / "whole"), "graphs")
    rows = lambda d, *c: sorted(map(str, d.select(*c).collect()))
    for name, columns in (("entities", ["entity_id", "source_paper_id"]), ("relationships", ["source_entity_id", "target_entity_id", "relationship_type"])):
        assert rows(target.table(spark, name), *columns) == rows(whole[name], *columns)
    assert rows(target.table(spark, "papers"), "title") == rows(df, "title")
    target.compact(spark, 3)
    for name, columns in (("entities", ["entity_id", "source_paper_id"]), ("relationships", ["source_entity_id", "target_entity_id", "relationship_type"])):
        assert rows(target.table(spark, name), *columns) == rows(whole[name], *columns)
    assert target.table(spark, "papers").count() == 3
    runs = {str(f.parent) for f in (tmp_path / "out" / "papers").rglob("*.parquet")}
    assert all(r.endswith("run=m3") for r in runs)
    # a paper that cites merged ones
    later = ("p9", "Surveying the Surveys", None, 9, [(0, "References\n[1] Z. Later Survey of Graphs. 2018.\n[2] Mixing graphs anew today.")], 1)
    target(of([later]), 4)
    found = target.table(spark, "relationships").where("paper_id = 'p9' and relationship_type = 'cites'")
    assert rows(found, "evidence") == ["Row(evidence='Later Survey of Graphs')", "Row(evidence='Mixing Graphs Anew Today')"]


def test_refresh_reads_what_the_batch_touches(spark, tmp_path):
    target = CorpusRefresher(str(tmp_path / "out"), shards=64)
    shape = "paper_id STRING, title STRING, abstract STRING, ord BIGINT, version BIGINT, batch_id BIGINT"
    stored = spark.createDataFrame([(f"s{i}", f"Stored Paper Number {i} of Many", None, i, 1, 0) for i in range(300)], shape)
    target._store(stored, "papers", "b0")
    whole = target._open(spark, "papers").inputFiles()
    one = target.earlier(spark.createDataFrame([("s7",)], "paper_id STRING"), "papers", 1)
    assert len(one.inputFiles()) == 1 < 50 < len(whole) and [r.title for r in one.collect()] == ["Stored Paper Number 7 of Many"]
    assert target.earlier(spark.createDataFrame([("s7",)], "paper_id STRING"), "papers", 0).count() == 0


def test_rows_are_not_moved_again_for_their_numbers(spark):
    """The sizes of partitions, one row each, go to the rows and not the rows to them."""
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x" * 20).alias("load"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = enumerated(df, ["k"], "n")
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert all(r.k == r.n for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
