import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import language_model as lm
from folioscope.llm.queries import op2_lm_scores


def brute(rows, held_out):
    tokens = {d: (t or "").encode().lower().split() + [b""] for d, t in rows}
    seen = Counter(w for d, ws in tokens.items() if not held_out(d) for w in ws)
    n, v = sum(seen.values()), len(seen)
    return n, {d: (len(ws), sum(seen[w] > 0 for w in ws), sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens.items()}


@pytest.mark.parametrize("sent", [5, 131_072])
def test_base_equals_brute_force(spark, small, monkeypatch, sent):
    monkeypatch.setattr(lm, "SENT", sent)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    n, want = brute(rows, lambda d: zlib.crc32(str(d).encode()) % 7 == 2)
    got = op2_lm_scores(spark, small).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    for r in got:
        tokens, known, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (tokens, known) and r.base_score == pytest.approx(base)
        assert r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_score_beats_base_on_held_out(spark):
    got = op2_lm_scores(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_probabilities_sum_to_one(spark, docs_of, monkeypatch):
    """Over every known word and, for each class, everything unseen in it."""
    monkeypatch.setattr(lm, "HEADS", 3)
    monkeypatch.setattr(lm, "CLASSES", 5 + lm.TAILS)
    rng = np.random.default_rng(0)
    model = lm.Model.start(np.full(lm.CLASSES, 1 / lm.CLASSES))
    model.r += rng.normal(size=model.r.shape).astype(np.float32)
    n = np.arange(lm.CLASSES)
    far, near = np.full(lm.CLASSES, 7), np.full(lm.CLASSES, 9)
    logs = lm.Scorer(model).classes(far, near, n)
    assert (10 ** logs[1:]).sum() == pytest.approx(1, abs=1e-5)
    counted = lm.counts(docs_of([(1, "b a a c d e f e")]), F.lit(True))
    v = lm.vocabulary(counted, "t")
    seen = {bytes(r.word): r.n for r in counted.collect()}
    heads = set(v.words[: lm.HEADS])
    for c in range(2 + lm.HEADS, lm.CLASSES):
        inside = [w for w in seen if w and w not in heads and lm.tail(w) == c]
        assert v.class_tokens[c] == sum(seen[w] for w in inside) and v.class_distinct[c] == len(inside)


def test_training_learns_order():
    shares = np.full(lm.CLASSES, 1e-6)
    shares[1:11] = 0.1
    shares /= shares.sum()
    trainer = lm.Trainer(shares)
    rng = np.random.default_rng(1)
    for _ in range(60):
        near = rng.integers(1, 11, 2000)
        trainer.step(rng.integers(1, 11, 2000), near, near % 10 + 1)
    ask = np.arange(1, 11)
    right = lm.Scorer(trainer.model).classes(ask[::-1].copy(), ask, ask % 10 + 1)
    assert right.mean() > math.log10(0.3)


def test_odd_tables(spark, docs_of):
    rows = docs_of([(1, "A b", 0.5), (1, "b", 0.5), (None, "Z", 0.5), (None, None, 0.5), (4, "", 0.5), (5, "w " * 100_000, 0.5)], ", score double")
    got = {r.doc_id: r for r in lm.score_corpus(rows, "doc_id = 4").collect()}
    assert {k: r.n_tokens for k, r in got.items()} == {1: 5, None: 3, 4: 1, 5: 100_001}
    assert [k for k, r in got.items() if r.held_out] == [4]
    assert lm.score_corpus(docs_of([]), "doc_id = 4").count() == 0
    untrained = lm.score_corpus(docs_of([(1, "a b")]), "doc_id = 1").first()
    assert (untrained.train_tokens, untrained.n_known, untrained.n_tokens) == (0, 0, 3)
