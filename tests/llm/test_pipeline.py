import re

import corpus_pipeline
from __spark_entry__ import queries
from folioscope.llm import quality
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near import brute_components, brute_of, brute_print


def brute_groups(texts):
    """Components over fingerprints within two bits or similar shingle sets."""
    prints = brute_components([brute_print(t) for t in texts])
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in ((t or "").encode().lower().split() for t in texts)]
    pairs = [(i, g) for i, g in enumerate(prints)]
    pairs += [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return brute_of(texts, pairs)


def test_registered():
    names = set(queries())
    assert "pipeline" in names and {re.match(r"op\d+", n)[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_equal_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    judged = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "cost_packing":
            assert {r.doc_id for r in docs.collect()} == set(seen)
            assert docs.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0
            continue
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            want = {d: t for d, t in seen.items() if d in judged}
        elif name == "near_dedup":
            order = sorted(seen)
            groups = brute_groups([seen[d] for d in order])
            want = {d: seen[d] for d, g in zip(order, groups) if order[g] == d}
        elif name == "decontamination":
            hit = leaks(list(seen.items()), items)
            want = {d: t for d, t in seen.items() if not hit[d][1]}
        else:
            private = re.compile(r"@mail\d|\b\d{16}\b|\b(?:\d{1,3}\.){3}\d{1,3}\b|AKIA|password=|\(\d{3}\) 555")
            assert set(got) == set(seen)
            want = {d: got[d] if private.search(t) or "token" in t else t for d, t in seen.items()}
            assert all(got[d] != t for d, t in seen.items() if private.search(t))
        assert got == want, name
        assert len(got) <= len(seen)
        seen = got
