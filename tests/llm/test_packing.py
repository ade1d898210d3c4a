import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioscope.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check(pieces, texts, tokenizer):
    """Every id once, in order; sequences gapless and at most LENGTH."""
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for t in texts)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    got = []
    for own in by_doc.values():
        ids, at = [], 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            ids += np.frombuffer(p.ids, "<u4").tolist()
            at += p.length
        assert at == own[0].doc_tokens
        got.append(tuple(ids))
    assert sorted(got) == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.LENGTH
    return sequences


def test_documents(spark, small, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 64)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pieces = packing.pack(docs, PATH).collect()
    sequences = check(pieces, [r.text for r in docs.collect()], tokenizer)
    shards = -(-docs.count() // 64)
    assert len(sequences) <= sum(p.length for p in pieces) / packing.LENGTH + shards


TEXTS = [
    "", None, "one  two", "a\n b", "tab\t x \n\n  y ", "nul\0 x", "<|endoftext|> kept as text", "it's  'll don't", "é ü   z",
    " lead", "trail ", "  ", "\x1c x", "😀 ok " * 40, "12 345 6789, ok? (yes) [no]", "word " * 40_000,
]


def test_chunks_have_the_tokenizer_s_ids(tokenizer):
    own = packing.Ids(PATH)
    texts = [t or "" for t in TEXTS]
    for text, packed in zip(texts, own.encode(texts)):
        assert np.frombuffer(packed, own.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_odd_tables(spark, docs_of, tokenizer):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)]
    pieces = packing.pack(docs_of(rows, ", shard int"), PATH).collect()
    check(pieces, TEXTS, tokenizer)
    assert packing.pack(docs_of([]), PATH).count() == 0
    again = packing.pack(docs_of([(1, "x y"), (1, "x y"), (None, "z")]), PATH).collect()
    assert len(again) == 3 and len({p.sequence_id for p in again}) == 1
    row = packing.digests(packing.pack(docs_of([(1, "x y")]), PATH)).first()
    ids = np.array(tokenizer.encode("x y").ids + [0], "<u4")
    assert row.ids_crc32 == zlib.crc32(ids.tobytes())


def test_assignment_balances_cost():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 700, 400)
    put = packing.assign(sizes)
    used, cost = {}, {}
    for piece, skip, size, seq, offset in put:
        assert used.get(seq, 0) == offset
        used[seq] = offset + size
        cost[seq] = cost.get(seq, 0) + packing.LINEAR * size + packing.QUADRATIC * size * size
    assert sum(used.values()) == sizes.sum() and len(used) == -(-sizes.sum() // 1024)
    assert max(used.values()) <= 1024
    full = sorted(cost.values())
    assert full[-1] < 2 * full[len(full) // 2]
    cuts = sum(1 for _, skip, *_ in put if skip)
    assert cuts < len(used)


def test_repeated_rows_spread(spark, docs_of):
    rows = packing.tokenised(docs_of([(7, "same text")] * 600).repartition(3), PATH, 3).groupBy("shard").count().collect()
    assert len(rows) == 3 and max(r["count"] for r in rows) < 300


def test_memory_of_two_generations(tokenizer, monkeypatch):
    """Small memories forget rare chunks only, and ids stay right."""
    monkeypatch.setattr(packing, "MEMORY", 5)
    ids, texts = packing.Ids(PATH), [f"often word{i} often rare{i * i} é{i}" for i in range(40)]
    for t in texts + texts[::-1]:
        assert np.frombuffer(ids.encode([t])[0], ids.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        assert "often" in ids.known and " often" in ids.known
    assert len(ids.known) + len(ids.old) < 30


def test_a_worker_at_rest_forgets(monkeypatch):
    import time

    import public_tokenizers

    monkeypatch.setattr(packing, "IDLE", 0.05)
    own = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    first = own.encode(["some words and some more"])
    own.end()
    own.begin()
    time.sleep(0.2)
    assert own.known  # a task has begun
    own.end()
    time.sleep(0.3)
    assert not own.known and not own.old
    assert own.encode(["some words and some more"]) == first
