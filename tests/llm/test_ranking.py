import math
import random
import re
from collections import Counter

import pytest

from __spark_entry__ import oracle_sql, queries
from folioscope.llm import ranking
from tools.compare import compare, connect


def brute(docs, items, k=50):
    """Every document scored for every query, in whole numbers."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(split(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(split(text))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // total if total else 50
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=50, parts=3):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    items = spark.createDataFrame(items, "item_id string, text string")
    got = ranking.search(ranking.build_index(docs), items, k)
    return sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def random_docs(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    pick = lambda: words[min(int(rng.expovariate(0.03)), 399)]
    return [(i, " ".join(pick() for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 7, 50])
def test_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(ranking, "WINDOW", 64)
    docs, rng = random_docs(900), random.Random(5)
    items = [(f"q{i}", " ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randint(1, 25)))) for i in range(30)]
    assert found(spark, docs, items, k) == brute(docs, items, k)


def test_many_shards_and_parts_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SHARD_DOCS", 50)
    monkeypatch.setattr(ranking, "QUERIES", 4)
    docs = random_docs(400, 2)
    items = [(f"q{i}", f"w{i} w{3 * i} w0 unknown") for i in range(20)]
    assert found(spark, docs, items, 10) == brute(docs, items, 10)


def test_short_lists_only_and_long_lists_only(spark):
    docs = [(i, f"common rare{i % 300} " + "pad " * (i % 7)) for i in range(600)]
    items = [("short", "rare7 rare8 rare9"), ("long", "common pad"), ("both", "rare7 common pad rare250")]
    assert found(spark, docs, items) == brute(docs, items)


def test_ties_copies_and_odd_rows(spark):
    docs = [(5, "same words here"), (3, "same words here"), (4, "same words here"), (9, None), (8, ""), (7, " .,! "),
            (None, "same words"), (1, "Ünïcode WORDS straße日本"), (6, "other" * 9000)]
    items = [("a", "SAME words"), ("b", None), ("c", ""), ("d", "nowhere"), ("e", "straße日本"), (None, "here"), ("a", "here")]
    got = found(spark, docs, items, parts=1)
    assert got == brute(docs, items)
    assert sorted(r[1:3] for r in got if r[0] == "a") == [(1, 3), (2, 4), (3, 5), (4, 1)]


def test_repeated_rows_are_documents(spark):
    rows = [(1, "alpha beta"), (1, "alpha beta"), (2, "alpha"), (3, "gamma")]
    got = found(spark, rows, [("q", "alpha")])
    assert [(r[1], r[2]) for r in got] == [(1, 2), (2, 1), (3, 1)]


@pytest.mark.parametrize("docs, items", [([], [("q", "a")]), ([(1, "a")], []), ([(1, None)], [("q", "a")])])
def test_empty(spark, docs, items):
    assert found(spark, docs, items, parts=1) == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x"), (2, "b", 8, "y")], "doc_id long, text string, shard long, term string")
    items = spark.createDataFrame([("q", "a", 1, 2)], "item_id string, text string, part long, weight long")
    assert [tuple(r) for r in ranking.search(ranking.build_index(docs), items).select("doc_id").collect()] == [(1,)]


def test_query_equals_sql(spark, small):
    text, _, same = compare(spark, connect(small), small, "op11_lexical_search")
    assert same and "op11_lexical_search" in oracle_sql() and "op11_lexical_search" in queries(), text
