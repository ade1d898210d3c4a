"""Registered queries: SQL twins agree at the smallest scale, plans stay joinable."""

import pathlib
import re
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from folioscope.plans.bindings import QUERIES
from folioscope.plans.oracle import ORACLE
from tools.compare import compare, connect

ROOT = pathlib.Path(__file__).resolve().parents[1]

# one of every kind here; tools/compare.py runs all of them
SAMPLE = ["vocab_match", "segment_turns", "bm25_topk", "citation_match", "timeline_points",
          "recommend_topk", "token_bucket", "upsert_papers"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_sql_twin(spark, small, name):
    text, _, same = compare(spark, connect(small), small, name)
    assert same, text


@pytest.mark.parametrize("hidden", ["zstandard", "folioscope.llm", "corpus_pipeline"])
def test_core_stays_without_the_training_data_part(hidden):
    code = (f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; "
            "assert e.queries() and not any(n.startswith('op') for n in e.queries()); print(len(e.queries()))")
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True)
    assert int(ran.stdout) == len(QUERIES) and "left out" in ran.stderr


def test_entry(spark):
    assert entry(spark).count() == 10


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["citation_match", "novelty_overlap", "recommend_topk", "missing_citations",
                                  "resolve_edges", "paper_subgraph", "claim_figures"])
def test_no_all_pairs_join_and_no_python(spark, small, name):
    text = plan(queries()[name](spark, small))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|MapInPandas", text)


def test_responses_are_read_once(spark, small):
    assert "from_json" not in plan(queries()["coalesce_extractions"](spark, small))


def test_scans_read_only_needed_columns(spark, small):
    text = plan(queries()["contradictions"](spark, small))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in text
    text = plan(queries()["status_breakdown"](spark, small))
    assert "ReadSchema: struct<event_type:string>" in text
