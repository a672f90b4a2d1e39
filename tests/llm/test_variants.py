import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from attest.llm import variants

from .helpers import collected, documents, empty

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(words):
    """Neighbours by the words with one character masked or left out."""
    near = defaultdict(set)
    masks, gone = defaultdict(list), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            masks[w[:i], w[i + 1:]].append(w)
        for d in {w[:i] + w[i + 1:] for i in range(len(w))}:
            gone[d].append(w)
    for group in masks.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    for w in words:
        for x in gone.get(w, ()):
            near[w].add(x)
            near[x].add(w)
    out = []
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append({"word": w, "form": form[w], "root": root, "n": n, "n_near": len(near[w]), "form_n": words.get(form[w])})
    return sorted(out, key=lambda r: r["word"])


def found(df):
    return sorted(collected(df), key=lambda r: r["word"])


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_and_roots_are_those_of_brute_force(spark, seed):
    rnd = random.Random(seed)
    alphabet = "ab" if seed == 1 else "abcÀÿé÷"
    words = {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(5, 9))): rnd.choice((3, 3, 4, 6, 12, 30, 100)) for _ in range(150)}
    long = "".join(rnd.choice(LETTERS) for _ in range(400))
    for i in (0, 17, 199, 200, 201, 399):  # changes at both ends, in the middle and at the borders of levels
        words[long[:i] + long[i + 1:]] = 5
        words[long[:i] + "ab"[long[i] == "a"] + long[i + 1:]] = 10
    words |= {long: 40, long + "x": 3, "x" + long: 3, "a" * 30: 3, "a" * 31: 6, "a" * 32: 20}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(variants.variants(df)) == brute(words)


def test_levels_double(spark):
    at = variants.cuts(1_000_000)
    assert at[:5] == [0, 2, 4, 6, 8] and at[-1] >= 1_000_000 and len(at) < 40


def test_words_of_texts(spark):
    rnd = random.Random(4)
    pool = ["Straße", "straSse", "Élan", "élans", "hello", "Hello", "hellö", "hullo", "a", "word's", "×÷×÷×", "nAÏve", "x" * 500]
    texts = [" ".join(rnd.choice(pool) + rnd.choice(("", ",", "1", "\n")) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    df = documents(spark, [(t, "en") for t in texts]).withColumn("n", F.lit("other"))
    rows = [(r["doc_id"], r["text"]) for r in collected(df)]
    words = variants.materialise(variants.run_counts(df), "words")
    assert {r["word"]: r["n"] for r in collected(words)} == brute_words(rows)
    assert found(variants.variants(words)) == brute(brute_words(rows))
    assert collected(variants.variants(variants.run_counts(empty(df)))) == []


def test_long_texts_and_forgotten_counts(spark, monkeypatch):
    monkeypatch.setattr(variants, "LONG", 20)
    monkeypatch.setattr(variants, "COUNTED", 2)
    rows = [(i, "some words stand here, others there " * 9) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in collected(variants.run_counts(df))} == brute_words(rows)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert found(variants.op12_variants(spark, d)) == brute(brute_words(rows))
