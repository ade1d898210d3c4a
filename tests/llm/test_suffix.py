import hashlib
import random

import numpy as np
import pytest

from folioscope.llm import collection, suffix


def brute(rows, window=50):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - window + 1):
            w = data[i : i + window]
            if doc is not None:
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            least = first.get(data[i : i + window])
            if least is not None and (doc is None or least < doc):
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, y in zip(data, gone) if not y)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(
        ((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str
    )


@pytest.mark.parametrize("step", [3, 50, 1 << 18])
def test_transform_equals_sorted_suffixes(monkeypatch, step):
    monkeypatch.setattr(collection, "STEP", step)
    random.seed(step)
    for trial in range(40):
        letters = b"ab" if trial % 2 else b"abc\xc3"
        strings = [bytes(random.choices(letters, k=random.randint(0, 12))) for _ in range(random.randint(0, 7))]
        strings += strings[:1]
        ends = np.cumsum([len(s) for s in strings])
        data = b"".join(strings)
        place, prefix = collection.suffixes(strings)
        made = [data[p : ends[np.searchsorted(ends, p, "right")]] for p in place]
        assert made == sorted(made) and len(made) == len(data)
        for a, b, n in zip(made, made[1:], prefix[1:]):
            assert a[:n] == b[:n] and (len(a) == n or a[n : n + 1] != b[n : n + 1])


@pytest.mark.parametrize("hot", [2, 8000])
def test_documents_equal_brute_force(spark, small, hot):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(suffix.remove_repeats(docs, together=300, hot=hot)) == brute(rows)


def test_odd_tables(spark, docs_of, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 200)
    passage = "the quick brown fox jumps over the lazy dog and runs away fast"
    rows = [
        (3, passage + " tail"), (1, "start " + passage), (2, passage), (2, passage), (None, passage), (7, None), (8, ""), (9, "short"),
        (10, "é" * 60), (11, "xé" + "é" * 60), (12, "a" * 120), (13, "a" * 50), (14, "of " * 200), (15, "of " * 100), (None, "é" * 30),
    ]
    df = docs_of([(*r, "x") for r in rows], ", block string")
    assert found(suffix.remove_repeats(df)) == brute(rows)
    assert suffix.remove_repeats(docs_of([])).count() == 0
    assert found(suffix.remove_repeats(docs_of([(1, "tiny"), (2, None)]))) == brute([(1, "tiny"), (2, None)])


def test_spans_tell_what_goes(spark, docs_of):
    passage = "0123456789" * 6
    got = {r.doc_id: r for r in suffix.remove_repeats(docs_of([(1, passage), (2, "ab" + passage + "cd")])).collect()}
    assert [(s.start, s.stop) for s in got[2].spans] == [(2, 62)] and bytes(got[2].kept) == b"abcd"


def test_only_parts_that_may_repeat_are_built(monkeypatch):
    built, whole = [], collection.build
    monkeypatch.setattr(collection, "build", lambda strings: built.append(strings) or whole(strings))
    rng = random.Random(5)
    alone = [bytes(rng.choices(b"abcd", k=40)) for _ in range(50)]
    low = collection.window_minima([*alone, b"x" * 5 + b"0123456789" + b"y" * 5, b"z" * 4 + b"0123456789"], np.arange(52), 10)
    assert built == [[b"0123456789"]]
    assert [x.tolist() for x in low[50:]] == [[50] * 11, [51] * 4 + [50]]
    assert all((x == i).all() for i, x in enumerate(low[:50]))


def test_window_minima_equal_brute_force():
    rng = random.Random(6)
    for turn in range(200):
        strings = [bytes(rng.choices(b"ab\x00", k=rng.randrange(0, 30))) for _ in range(rng.randrange(0, 12))]
        marks = np.array([rng.randrange(9) for _ in strings], np.int64)
        least = {}
        for s, mark in zip(strings, marks.tolist()):
            for i in range(len(s) - 4):
                least[s[i : i + 5]] = min(least.get(s[i : i + 5], mark), mark)
        low = collection.window_minima(strings, marks, 5)
        assert [x.tolist() for x in low] == [[least[s[i : i + 5]] for i in range(len(s) - 4)] for s in strings]
