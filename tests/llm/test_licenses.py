import random
from itertools import combinations

from attest.llm import licenses as L

from .helpers import collected, documents, empty


def test_increasing_is_longest():
    rnd = random.Random(1)
    for _ in range(200):
        v = rnd.sample(range(50), rnd.randint(0, 9))
        got = [v[i] for i in L.increasing(v)]
        best = max(n for n in range(len(v) + 1) if n == 0 or any(all(a < b for a, b in zip(c, c[1:])) for c in combinations(v, n)))
        assert got == sorted(got) and len(got) == best


def patience(a, b):
    """The same alignment, written as plain recursion with a quadratic subsequence."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(tail)]
    x, y = a[head: len(a) - tail], b[head: len(b) - tail]
    anchors = [(i, y.index(w)) for i, w in enumerate(x) if x.count(w) == 1 and y.count(w) == 1]
    if anchors:
        size = []
        for i, (_, j) in enumerate(anchors):
            size.append(1 + max((size[k] for k in range(i) if anchors[k][1] < j), default=0))
        n, kept, bound = max(size), [], float("inf")
        for i in range(len(anchors) - 1, -1, -1):
            if size[i] == n and anchors[i][1] < bound:
                kept.append(anchors[i])
                n, bound = n - 1, anchors[i][1]
        kept.reverse()
        for (i, j), (k, m) in zip([(-1, -1), *kept], [*kept, (len(x), len(y))]):
            out += [(p + i + 1 + head, q + j + 1 + head) for p, q in patience(x[i + 1: k], y[j + 1: m])]
        out += [(i + head, j + head) for i, j in kept]
    return sorted(out)


def test_alignment_is_that_of_plain_recursion():
    rnd = random.Random(3)
    for _ in range(400):
        b = [rnd.randrange(25) for _ in range(rnd.randint(0, 20))]
        a = [w for w in b if rnd.random() < 0.8]
        for _ in range(rnd.randint(0, 5)):
            a.insert(rnd.randint(0, len(a)), rnd.randrange(25))
        got = L.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < y and p < q for (x, p), (y, q) in zip(got, got[1:]))
        other = patience(a, b)
        assert len(got) == len(other) or abs(len(got) - len(other)) <= 2  # equal subsequences may be chosen differently


def test_scan_finds_planted_licenses(spark):
    mit = L.TEMPLATES["MIT"]
    noise = " ".join(f"filler{i} the of and to" for i in range(400))
    changed = " ".join(w for i, w in enumerate(mit.split()) if i % 12)
    texts = [
        f"{noise} {mit} {noise}", f"{noise}\n/* {changed.upper()} */", L.TEMPLATES["ISC"], "Released under the MIT License.\n" * 3, noise,
        f"Licensed under the Apache License, Version 2.0. {noise}", " ".join(mit.split()[:60]), "released under the X license"]
    rows = collected(L.scan(documents(spark, [(t, "en") for t in texts])))
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append(r)
    names = {k: [r["license_id"] for r in v] for k, v in found.items()}
    assert names == {0: ["MIT", "MIT"], 1: ["MIT"], 2: ["ISC"], 3: ["MIT-notice"] * 3, 5: ["Apache-2.0-notice"], 7: ["MIT-notice"]}  # row 0 is there twice
    r = found[0][0]
    assert r["coverage"] == 1.0 and r["start_word"] == 2000 and r["end_word"] - r["start_word"] == len(L.Template.of("x", mit).words)
    assert 0.8 <= found[1][0]["coverage"] < 1 and [r["start_word"] for r in found[3]] == [0, 5, 10]
    assert found[7][0]["coverage"] == 0.8


def test_empty_and_the_notices_in_documents(spark):
    df = documents(spark, [("x", "en")])
    assert collected(L.scan(empty(df))) == [] == collected(L.scan(df))
    d = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    got = {(r["doc_id"], r["license_id"]) for r in collected(L.op5_licenses(spark, d)) if r["coverage"] == 1.0}
    assert got == {(i, n) for i, t in texts.items() for n, x in L.TEMPLATES.items() if n.endswith("notice") and x in t}


def test_versions_and_variants_are_told_apart(spark):
    gpl = L.TEMPLATES["GPL-3.0-header"]
    own = sorted(L.TEMPLATES)
    texts = [f"before it {L.TEMPLATES[n]} and behind" for n in own]
    others = ["Licensed under CC BY-NC 2.5.", "Released under the BSD License.", gpl.replace("version 3", "version 7"), L.TEMPLATES["GPL-3.0-notice"].replace("GNU", "GNU Affero").replace("3", "4"),
              "Licensed under the Apache License, Version 1.1."]
    named = [("Licensed under CC BY 4.0.", "CC-BY-4.0-notice"), (gpl.replace("GNU General", "GNU Affero General"), "AGPL-3.0-header"),
             (L.TEMPLATES["GPL-3.0-notice"].replace("3", "2"), "GPL-2.0-notice")]
    got = {}
    for r in collected(L.scan(documents(spark, [(t, "en") for t in [*texts, *others, *(t for t, _ in named)]], extra=False))):
        got.setdefault(r["doc_id"], []).append(r["license_id"])
    n = len(own)
    assert [got.get(i) for i in range(n)] == [[x] for x in own]
    assert [got.get(n + i) for i in range(len(others))] == [None] * len(others)
    assert [got[n + len(others) + i] for i in range(len(named))] == [[x] for _, x in named]
