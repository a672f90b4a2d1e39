import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.llm import winnow

from .helpers import collected, documents, empty

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        q = words(item)
        n = min(10, len(q))
        for k in range(len(q) - n + 1 if q else 0):
            for p in range(len(w) - n + 1):
                if w[p: p + n] == q[k: k + n]:
                    hit.update(range(p, p + n))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


def tables(seed):
    rnd = random.Random(seed)
    voc = ["a", "B", "É", "zz", "q1", "中"][: rnd.randint(2, 6)]

    def some(n):
        return " ".join(rnd.choice(voc) + rnd.choice(["", ".", "!A", " -"]) for _ in range(n))

    items = [(i, some(rnd.choice([0, 1, 2, 3, 9, 10, 11, 12, 15, 30]))) for i in range(8)]
    items += [(20, items[-1][1]), (21, None), (None, "a B"), (items[0][0], items[1][1])]
    texts = [some(rnd.randint(0, 40)) + " " + (rnd.choice(items)[1] or "") + " " + some(rnd.randint(0, 20)) for _ in range(25)]
    return items, texts


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block, often", [(16_000_000, 8), (200, 8), (16_000_000, 0), (16_000_000, 1)])
def test_same_as_brute_force(spark, monkeypatch, seed, block, often):
    """With `often` 0 or 1 windows are verified one by one instead of being extended."""
    of = winnow.Items.of

    def with_often(*args):
        monkeypatch.setattr(winnow, "OFTEN", often)  # of the driver, where items are put together
        return of(*args)

    monkeypatch.setattr(winnow.Items, "of", staticmethod(with_often))
    items, texts = tables(seed)
    docs = documents(spark, [(t, "en") for t in texts])
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hits string")
    rows = collected(winnow.contamination(docs, benchmark, block=block))
    assert len(rows) == docs.count()
    known = [(i, t) for i, t in items if i is not None]
    by_id = {r["doc_id"]: r["text"] for r in collected(docs)}
    for r in rows:
        got = r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), r["items"]
        assert got == brute(by_id[r["doc_id"]], known)


def test_repeated_words_take_linear_time(spark):
    """An item and a document of one word, and of two that alternate."""
    took = []
    for n in (4000, 16000):
        for text in ("same " * n, "one two " * (n // 2)):
            held = winnow.Items.of([("1", text.encode())], 10, 5)
            data = np.frombuffer((text * 4).encode(), np.uint8)
            t = winnow.flat.Tokens(data, np.array([0, len(data)]), winnow.WORD, winnow.flat.LOWER)
            began = time.time()
            assert winnow._merged([(a, b) for a, b, _ in held.hits(t, 10, 5)]) == [(0, 4 * n)]
            took.append(time.time() - began)
    assert max(took) < 10


def test_empty_tables(spark):
    docs = documents(spark, [("a b c", "en")])
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert all(not r["hits"] for r in collected(winnow.contamination(docs, empty(benchmark))))
    assert collected(winnow.contamination(empty(docs), benchmark)) == []


def test_query_on_a_small_table(spark):
    d = "/root/testdata/sf0.001"
    rows = collected(winnow.op7_winnow(spark, d))
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    texts = dict(spark.read.parquet(f"{d}/documents.parquet").filter(F.length("text") < 4000).select("doc_id", "text").collect())
    checked = 0
    for r in rows:
        if r["doc_id"] in texts:
            n, hit, names = brute(texts[r["doc_id"]], items)
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(names), hit > 0)
            assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
            checked += 1
    assert checked > 100 and any(r["contaminated"] for r in rows)


def test_long_text(spark):
    rnd = random.Random(1)
    body = " ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 50)) for _ in range(300_000))
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{body} {item} {body}")], "doc_id long, text string")
    r = collected(winnow.contamination(docs, spark.createDataFrame([(5, item)], "item_id long, text string")))[0]
    assert r["hits"] == [{"start": 300_000, "end": 300_030}] and r["items"] == ["5"]
