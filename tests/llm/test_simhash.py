import random

import numpy as np
import pytest
import xxhash

from attest.llm import bktree, graph, simhash

from .helpers import collected, documents, empty


def brute_fingerprint(text, k=3):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i: i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints_are_exact():
    for text in ("", "  \t", "One", "One TWO", "a b c", "É x\x0by z\x1cq a b", "a b c d " * 400):
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint("A B C") == xxhash.xxh64_intdigest(b"a b c", seed=42)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_trees_find_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    prints = np.unique(np.array([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 4).astype(np.uint64)) for c in np.repeat(centres, 40)], np.uint64))
    groups = np.sort(rng.integers(0, 2, len(prints)))
    got = {(int(a), int(b)) for x, y in bktree.Forest(prints, groups).within(radius) for a, b in zip(x, y)}
    assert got == {(i, j) for i in range(len(prints)) for j in range(len(prints))
                   if i != j and groups[i] == groups[j] and bin(int(prints[i]) ^ int(prints[j])).count("1") <= radius}


def _cluster(rnd, n, flips):
    base = rnd.getrandbits(64)
    out = set()
    while len(out) < n:
        x = base
        for _ in range(rnd.randint(0, flips)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return out


@pytest.mark.parametrize("cap", [512, 16])
def test_links_join_what_is_near(spark, cap):
    rnd = random.Random(cap)
    values = {0, (1 << 64) - 1, 1, 3}
    for _ in range(4):
        values |= _cluster(rnd, 60, 5)
    values |= {rnd.getrandbits(64) for _ in range(100)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    found = {(r["a"], r["b"]) for r in simhash.links(df, cap=cap).collect()}
    mask = (1 << 64) - 1
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & mask).count("1") <= 2]
    assert brute_components(found, signed) == brute_components(near, signed)


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rnd = random.Random(seed)
    pairs = [(i, i + 1) for i in range(200, 260)] + [(rnd.randrange(100), rnd.randrange(100)) for _ in range(60)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    nodes = {n for p in pairs for n in p}
    expected = brute_components(pairs, nodes)
    assert got == {n: r for n, r in expected.items() if n != r}
    assert graph.components(df.limit(0)).collect() == []


def test_query_rows(spark):
    df = documents(spark, [("the cat sat on the mat", "en"), ("THE cat sat on the mat", "en"), ("quite another text stands here", "en")])
    rows = collected(simhash.near_duplicates(df))
    assert len(rows) == df.count()
    texts = collected(df.select("doc_id", "text"))
    prints = {r["doc_id"]: brute_fingerprint(r["text"] or "") for r in texts}
    for r in rows:
        assert r["fingerprint"] % (1 << 64) == prints[r["doc_id"]]
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[1] == by[0] == 0 and by[2] == 2 and by[4] == by[5] == by[3] == 3 and by[None] is None
    assert collected(simhash.near_duplicates(empty(df))) == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if bin(prints[a] ^ prints[b]).count("1") <= 2]
    expected = brute_components(near, ids)
    rows = collected(simhash.op9_simhash(spark, d))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", expected[i]) for i in ids}


def test_wide_trees_answer_queries_of_their_group():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, (60, 2), dtype=np.uint64)
    prints[30:] = prints[:30] ^ (np.uint64(1) << rng.integers(0, 64, (30, 2)).astype(np.uint64))
    groups = np.arange(60) // 20
    forest = bktree.Forest(prints, groups)
    queries, trees = prints[::-1], np.arange(60) % 3
    got = sorted((int(a), int(b)) for x, y in forest.search(queries, trees, 40, 16) for a, b in zip(x, y))
    apart = lambda a, b: sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a, b))
    assert got == [(i, j) for i in range(60) for j in range(60) if trees[i] == groups[j] and apart(queries[i], prints[j]) <= 40]


@pytest.mark.parametrize("block", [512, 8])
def test_similar_texts(spark, block):
    rnd = random.Random(block)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(100, 400))]
        for _ in range(rnd.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(len(base) // 120):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    df = documents(spark, [(t, "en") for t in texts])
    rows = collected(simhash.similar_texts(df, block=block))
    assert len(rows) == df.count()
    comp = {r["doc_id"]: r["component_id"] for r in rows}

    def shingles(t):
        w = t.split()
        return set(zip(*(w[i:] for i in range(5))))

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            x = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if x >= 0.9 or x < 0.3:
                assert (comp[i] == comp[j]) == (x >= 0.9), x
    n = len(texts)
    assert comp[n] == comp[n + 1] == comp[n + 2] == n and comp[None] is None
    assert collected(simhash.similar_texts(empty(df))) == []


def test_wide_fingerprints_count_a_repeated_shingle_once():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    line = " ".join(word() for _ in range(7))
    a, b = ("\n".join([" ".join(word() for _ in range(300)), *[line] * 40]) for _ in range(2))
    x, y = (np.frombuffer(simhash.wide_fingerprint(t), np.uint8) for t in (a, b))
    assert np.bitwise_count(x ^ y).sum() > 90
    assert simhash.wide_fingerprint(f"{line} {line} {line}") == simhash.wide_fingerprint(" ".join([line] * 9))


@pytest.mark.parametrize("block", [512, 4])
def test_similar_texts_link_from_the_stated_similarity_on(spark, block):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    texts, alike = [], []
    for k in range(24):  # 80 of 100 shingles are shared, and 79 of 100 or 80 of 101
        base = [word() for _ in range(84 - (k % 4 == 3))]
        tail = 20 + (k % 2 and 1)
        alike.append(k % 2 == 0)
        texts += [" ".join(base), " ".join(base + [word() for _ in range(tail)])]
    line = " ".join(word() for _ in range(7))
    texts += ["\n".join([" ".join(word() for _ in range(100)), *[line] * 40]) for _ in range(6)]  # unlike but for a repeated line
    hub = [word() for _ in range(404)]
    texts += [" ".join(w if i % 40 or i // 40 != k else word() for i, w in enumerate(hub)) for k in range(30)]  # many copies
    comp = {r["doc_id"]: r["component_id"] for r in collected(simhash.similar_texts(documents(spark, [(t, "en") for t in texts], extra=False), block=block))}
    assert [comp[2 * k + 1] == comp[2 * k] for k in range(24)] == alike
    assert [comp[48 + k] for k in range(6)] == [48 + k for k in range(6)]
    assert {comp[54 + k] for k in range(30)} == {54}
