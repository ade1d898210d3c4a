import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import near


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(prints, radius=2):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_documents_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_print(d.text) for d in docs]
    groups = brute_components(prints)
    least = {}
    for d, g in zip(docs, groups):
        least[g] = min(least.get(g, d.doc_id), d.doc_id)
    got = {r.doc_id: r for r in near.near_duplicates(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    for d, p, g in zip(docs, prints, groups):
        assert got[d.doc_id].fingerprint == f"{p:016x}" and got[d.doc_id].component_id == least[g]


def test_words_are_ascii_lowered_and_split(spark, docs_of):
    texts = ["A b\tC d", "a B c\x0bD", "É b c", "é b c", None, "", " \n", "Two words", "x" * 100_000, "w " * 200_000]
    got = {r.doc_id: r.fingerprint for r in near.near_duplicates(docs_of(list(enumerate(texts)))).collect()}
    assert got == {i: f"{brute_print(t):016x}" for i, t in enumerate(texts)}
    assert got[0] == got[1] and got[2] != got[3] and got[4] == "0" * 16


def points(seed, n):
    rng = np.random.default_rng(seed)
    far = rng.integers(0, 1 << 63, n).astype(np.uint64)
    close = far[: n // 3] ^ (np.uint64(1) << rng.integers(0, 64, n // 3).astype(np.uint64))
    dense = far[0] ^ rng.integers(0, 4096, n // 4).astype(np.uint64)
    chain = np.array([(1 << (2 * k)) - 1 for k in range(20)], np.uint64)
    return np.unique(np.concatenate([far, close, dense, chain]))


def test_tree_and_shards_find_all_links(monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 1 << 10)
    own = points(3, 600)
    want = brute_components(own.tolist())
    assert brute_of(own, near.links(own, np.zeros(len(own), bool), 2)) == want
    shards = {}
    for shard, rows, visiting in near.route(near.grow(own, 12), own, 2):
        shards.setdefault(shard, []).append((rows, visiting))
    assert len(shards) == 12
    pairs = []
    for parts in shards.values():
        rows = np.concatenate([r for r, _ in parts])
        visiting = np.concatenate([np.full(len(r), v) for r, v in parts])
        pairs += rows[near.links(own[rows], visiting, 2)].tolist()
    assert brute_of(own, pairs) == want


def brute_of(own, pairs):
    label = list(range(len(own)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(own))]


def test_components_on_spark(spark, monkeypatch):
    monkeypatch.setattr(near, "SHARD", 64)
    own = points(5, 400)
    want = brute_components(own.tolist())
    random.seed(1)
    ids = random.sample(range(10_000), len(own))
    rows = [(i, int(p.astype(np.int64))) for i, p in zip(ids, own)] * 2
    got = {r.doc_id: r.component_id for r in near.components(spark.createDataFrame(rows, "doc_id long, point long")).collect()}
    least = {}
    for i, g in zip(ids, want):
        least[g] = min(least.get(g, i), i)
    assert got == {i: least[g] for i, g in zip(ids, want)}


def test_odd_tables(spark, docs_of):
    assert near.near_duplicates(docs_of([])).count() == 0
    rows = docs_of([(5, "a b c", 1), (5, "a b c", 1), (None, "a b c", 2), (2, None, 3), (9, "", 4)], ", point long")
    got = sorted((r.doc_id or -1, r.component_id) for r in near.near_duplicates(rows).collect())
    assert got == [(-1, 5), (2, 2), (5, 5), (5, 5), (9, 2)]
    kept = near.drop_near_duplicates(rows)
    assert kept.columns == ["doc_id", "text", "point"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 5, 5]
    nameless = docs_of([(None, "q r s"), (None, "q r s")])
    assert near.near_duplicates(nameless).where(F.col("component_id").isNull()).count() == 2


def test_similar_copies_are_found(spark, docs_of):
    random.seed(8)
    rows = []
    for i in range(40):
        words = [f"w{random.randrange(5000)}" for _ in range(random.randint(12, 150))]
        rows.append((1000 - i, " ".join(words)))
        for k in range(3):
            copy = words[:]
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = "changed"
            rows.append((5000 + 10 * i + k, " ".join(copy)))
    sets = {d: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for d, t in rows}
    want = {tuple(sorted((a, b))) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    ids = sorted(sets)
    place = {d: k for k, d in enumerate(ids)}
    groups = lambda pairs: brute_of(ids, [(place[a], place[b]) for a, b in pairs])
    df = docs_of([*rows, (None, rows[0][1]), (1, None), (2, "")])
    got = [(r.a, r.b) for r in near.similar_links(df).collect()]
    assert all(tuple(sorted(p)) in want for p in got) and groups(got) == groups(want)
    kept = {r.doc_id for r in near.drop_near_duplicates(df).collect()}
    assert kept >= {ids[k] for k, g in enumerate(groups(want)) if k == g} - {2}


def test_original_of_middle_id_meets_all_copies(spark, docs_of):
    """1000 copies of 0.85 to the original, less than 0.8 to each other; the
    original's id is neither first nor last."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(604)]
    shingles = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    own, rows = shingles(words), [(5_000, " ".join(words))]
    for i in range(1000):
        copy, places = words[:], rng.sample(range(1, 60), 10)
        for k in places:
            copy[10 * k] = f"c{i}x{k}"
        theirs = shingles(copy)
        assert len(own & theirs) >= 0.8 * len(own | theirs)
        rows.append((4_500 + i if i < 500 else 4_501 + i, " ".join(copy)))
    links = [(r.a, r.b) for r in near.similar_links(docs_of(rows)).collect()]
    place = {d: k for k, (d, _) in enumerate(rows)}
    assert set(brute_of(rows, [(place[a], place[b]) for a, b in links])) == {0}


def test_first_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 40, n // 8).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        common = np.unique(rng.choice(a, len(a) // 2))
        late = near.ordered(rng.permutation(common))
        if both and both >= 0.8 * (len(a) + len(b) - both):
            assert len(np.intersect1d(near._prefix(a, *late, 0.8), near._prefix(b, *late, 0.8)))


def test_shared_passages_crowd_the_first_shingles(spark, docs_of, monkeypatch):
    """Hundreds of texts share passages, so that their first shingles are crowded
    until these come last; near copies among them are still found."""
    monkeypatch.setattr(near, "HOT", 4)
    monkeypatch.setattr(near, "OFTEN", 2)
    monkeypatch.setattr(near, "LOOKED", 8)
    monkeypatch.setattr(near, "LAST", 300)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passages = [[word() for _ in range(60)] for _ in range(3)]
    texts = []
    for i in range(150):
        body = [word() for _ in range(rng.randint(20, 120))] + rng.choice(passages)
        texts.append(" ".join(body))
        if i % 5 == 0:  # similar ones, changed near the end
            texts += [" ".join([*body[: -k - 1], word(), *body[-k:]]) for k in (1, 2, 3)[: rng.randint(1, 3)]]
    texts += [" ".join(passages[0] + [word()]) for _ in range(12)]
    sets = [set(near.shingle_set(t).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = near.roots(near.similar_links(docs_of(list(enumerate(texts))))).collect()
    label = {r.point: r.root for r in got}
    want = brute_of(texts, pairs)
    groups = lambda f: sorted(sorted(i for i in range(len(texts)) if f(i) == r) for r in {f(i) for i in range(len(texts))})
    assert groups(lambda i: label.get(i, i)) == groups(lambda i: want[i])


def _groups(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in pairs:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def test_forest_of_tiles_connects_what_all_similar_pairs_do(monkeypatch):
    monkeypatch.setattr(near, "TILE", 5)
    monkeypatch.setattr(near, "PIECE", 32)
    rng = np.random.default_rng(7)
    for turn in range(60):
        bases = [rng.integers(1 << 62, size=int(rng.integers(1, 25))) for _ in range(3)]
        sets = []
        for _ in range(int(rng.integers(1, 30))):
            own = bases[rng.integers(3)].copy()
            own[rng.integers(len(own), size=int(rng.integers(0, 3)))] = rng.integers(1 << 62)
            sets.append(np.unique(own))
        side = np.zeros(len(sets), int) if turn % 2 else np.arange(len(sets)) % 2
        two_sided = side.any()
        similar = [
            (x, y) for x in range(len(sets)) for y in range(x)
            if (side[x] != side[y] or not two_sided)
            and len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))
        ]
        found = near.forest(sets, side, 0.8)
        assert _groups(len(sets), found) == _groups(len(sets), similar)
        assert set(map(frozenset, found)) <= set(map(frozenset, similar))


def test_forest_of_a_large_group_of_short_copies_stays_small():
    import tracemalloc

    rng = np.random.default_rng(8)
    base = rng.integers(1 << 62, size=20)
    sets = []
    for _ in range(3000):
        own = base.copy()
        own[rng.integers(20)] = rng.integers(1 << 62)
        sets.append(np.unique(own))
    tracemalloc.start()
    found = near.forest(sets, np.zeros(len(sets), int), 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(sets) - 1
    assert peak < 150 << 20


def test_large_groups_are_compared_by_blocks_stored_once(spark, monkeypatch):
    """Sets of a large group lie in one block each, however many blocks they meet."""
    monkeypatch.setattr(near, "HELD", 300)
    monkeypatch.setattr(near, "discard", lambda *tables: None)
    folders = []
    monkeypatch.setattr(near, "fresh_path", lambda spark, what, make=near.fresh_path: folders.append(make(spark, what)) or folders[-1])
    rng = np.random.default_rng(9)
    bases = [np.unique(rng.integers(1 << 62, size=n)) for n in (10, 12, 15, 30, 31, 60)]
    sets, roots = [], []
    for i in range(160):
        own = bases[i % 6].copy()
        own[rng.integers(len(own), size=int(rng.integers(0, 4)))] = rng.integers(1 << 62)
        sets.append(np.unique(own))
        roots.append(5 if i < 150 else 7)  # the second one is small
    rows = [(i, own.tolist(), root) for i, (own, root) in enumerate(zip(sets, roots))]
    found = [(r.a, r.b) for r in near._cells(spark.createDataFrame(rows, "doc_id long, own array<long>, root long"), 0.8).collect()]
    alike = lambda x, y: len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))
    similar = [(x, y) for x in range(len(sets)) for y in range(x) if roots[x] == roots[y] and alike(x, y)]
    assert _groups(len(sets), found) == _groups(len(sets), similar)
    assert set(map(frozenset, found)) <= set(map(frozenset, similar))
    stored = spark.read.parquet(folders[0])
    assert stored.count() == stored.select("doc_id").distinct().count() == 150
    assert stored.select("block").distinct().count() > 10


def test_similar_sets_are_in_neighbouring_classes(spark):
    got = spark.range(1, 3000).select("id", near._classes(F.col("id"), 0.8).alias("c")).collect()
    of = {r.id: r.c for r in got}
    assert all(0 <= of[min(2999, n * 5 // 4)] - of[n] <= 1 for n in of) and of[2999] > 20
