import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from attest.llm import turntrie

from .helpers import collected

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    return convs


def rebuilt(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + convs[c][h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def leaves(p):
        return sum(map(leaves, children[p])) if p in children else 1

    def saved(p):
        return (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(map(saved, children.get(p, ())))

    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        out.append({"conv_id": min(members), "depth": len(p), "parent_conv_id": min(nodes[p[:-1]]) if p else None, "n_convs": len(members),
                    "n_children": len(children.get(p, ())), "n_leaves": leaves(p), "saved_tokens": saved(p), "ends_sha256": hashlib.sha256(ends.encode()).hexdigest()})
    return out


def same(df, expected):
    key = lambda r: (r["depth"], r["conv_id"])
    assert sorted(collected(df), key=key) == sorted(expected, key=key)


def some(seed, n=60):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.choice((0, 1, 2, 3, 5, 9, 12))):
            rows.append((c, t, rnd.choice(("user", "assistant", None)), rnd.choice(("a", "é", "", None, "long " * 3))))
    rows += [(None, 0, "user", "no conversation"), (3, None, "system", "first"), (3, None, "system", "first"), (7, 2, "b", "tie"), (7, 2, "a", "tie")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_and_plain_tries_are_those_of_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(turntrie, "SEGMENT", 4)  # several segments and lists each
    rows = some(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("other") for n in ("node", "place", "n", "path", "h1", "depth")})
    convs = ordered(rows)
    same(turntrie.prefix_trie(df), brute(convs))
    turns = turntrie.materialise(turntrie.numbered(df), "turns")
    same(turntrie.trie(*turntrie.rebuilt(turns)), brute(rebuilt(convs)))


def test_copies_long_conversations_and_turnless_ones(spark):
    long = [("user", f"turn {i}") for i in range(300)]
    convs = {1: long, 2: long, 3: long[:3], 4: long[:2] + [("user", "else")], 9: [], -5: [("user", "x" * 100_000)]}
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    turns = turntrie.materialise(turntrie.numbered(spark.createDataFrame(rows, SCHEMA)), "turns")
    members = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    same(turntrie.trie(turns, members), brute(convs))


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert collected(turntrie.prefix_trie(df)) == []
    assert collected(turntrie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(turntrie.op11_turntrie(spark, d), brute(rebuilt(ordered(rows))))
