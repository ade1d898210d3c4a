import math
import re

import pytest

from folioscope.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    places = {}
    for i, w in enumerate(windows):
        places.setdefault(w, []).append(i)
    hit = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


TEXTS = [
    None, "", " \t\n", "one", "a b c d e f g h a b c d e f g h", "x\n\nx\n \nx y", "é # | ünï x <b>",
    "a b c d e f g h i j " * 7, " ".join(f"w{i}" for i in range(50)), "line one here\nline one here\nline two",
    "of of of of of of of of of of", " ".join(f"w{i % 37}" for i in range(90)), "\u001cx y\u0085z",
]


def test_counts_equal_brute_force(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, "null id")]
    made = quality.measure(docs_of(rows)).collect()
    assert len(made) == len(rows)
    by_id = {r.doc_id: r for r in made}
    for i, t in enumerate(TEXTS):
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t


def test_counts_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    made = {r.doc_id: r for r in quality.measure(docs).collect()}
    for d in docs.collect():
        r = made[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(d.text)


def fitted(patterns):
    """The same expectation-maximisation in plain Python."""
    prior, acc = quality.START_PRIOR, [quality.START_ACCURACY] * len(patterns[0][0])
    weight = quality.WEIGHT
    for _ in range(quality.ROUNDS):
        q = []
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(x * math.log(a / (1 - a)) for x, a in zip(v, acc))
            q.append(1 / (1 + math.exp(-odds)))
        total = sum(n for _, n in patterns)
        new = (sum(n * x for (_, n), x in zip(patterns, q)) + weight * quality.START_PRIOR) / (total + weight)
        out = []
        for r in range(len(acc)):
            right = sum(n * (x if v[r] == 1 else 1 - x) for (v, n), x in zip(patterns, q) if v[r])
            cast = sum(n for v, n in patterns if v[r])
            a = (right + weight * quality.START_ACCURACY) / (cast + weight)
            out.append(min(quality.ACCURACY[1], max(quality.ACCURACY[0], a)))
        prior, acc = min(quality.PRIOR[1], max(quality.PRIOR[0], new)), out
    return prior, acc


def test_fit_equals_plain_loop(spark):
    patterns = [([1, 0, 1], 50), ([0, -1, 0], 20), ([-1, -1, 0], 9), ([1, 1, 1], 30), ([0, 0, 0], 4)]
    rows = [(p,) for p, n in patterns for _ in range(n)]
    got = quality.fit(spark.createDataFrame(rows, "votes array<int>")).first()
    prior, acc = fitted(patterns)
    assert got.prior == pytest.approx(prior) and list(got.accuracy) == pytest.approx(acc)


def test_junk_goes_and_prose_stays(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").withColumnRenamed("quality", "label")
    seen = quality.judge(docs).join(labels, "doc_id").where("not base_failed").groupBy("label", "kept").count().collect()
    counts = {(r.label, r.kept): r["count"] for r in seen}
    assert not counts.get((1, False)) and counts[(1, True)] > 20


def test_odd_tables(spark, docs_of):
    empty = docs_of([])
    assert quality.judge(empty).count() == 0
    odd = docs_of([(1, "a", "x", 2), (1, "a", "x", 2), (None, None, None, None)], ", votes string, kept long")
    assert quality.judge(odd).count() == 3
    assert quality.keep_good(odd).columns == ["doc_id", "text", "votes", "kept"]
    long = docs_of([(1, "word " * 300_000)])
    assert quality.judge(long).first().n_repeat_words == 300_000


def test_no_python_runs(spark, small):
    plan = quality.judge(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
