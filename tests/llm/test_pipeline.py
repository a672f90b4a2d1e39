import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attest.llm import bpe, pipeline

from .helpers import collected, documents, empty
from .test_winnow import brute as hit_words

WORDS = {"en": "the and of to that with for was is this a in on at by from".split(), "de": "der die und das nicht ein für über schön mit ist zu auf".split()}


def shingles(text):
    w = text.encode().lower().split()
    return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(4)
    said = [" ".join(rnd.choice(WORDS[x]) + rnd.choice("abcdef") for _ in range(rnd.randint(8, 60))) for x in ("en", "de") * 60]
    fresh = [" ".join(rnd.choice(WORDS["en"]) + rnd.choice("ghijk") for _ in range(30)) for _ in range(3)]
    item = " ".join(f"bench{i}" for i in range(15))
    texts = [(t, ("en", "de")[i % 2]) for i, t in enumerate(said)]
    texts += [(said[0], "en"), (said[1].upper(), "de"), (f"{fresh[0]}, {item}. more", "en"), (fresh[1] + " password=abcdef123456 end", "de"), ("123 !!", "en"), (fresh[2], None)]
    df = documents(spark, texts)
    where = str(tmp_path_factory.mktemp("tables"))
    df.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    before = collected(docs.select(columns))

    told = pipeline.language(spark, docs, folder)
    rows = collected(told)
    assert told.columns == columns
    assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(str((r["doc_id"], r["text"])) for r in before if any(map(str.isalpha, r["text"] or "")))
    assert all(r["lang"] in WORDS for r in rows)

    kept = pipeline.near_dedup(spark, told, folder)
    got = collected(kept)
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows if r["doc_id"] is not None}
    left = {r["doc_id"] for r in got if r["doc_id"] is not None}
    assert kept.columns == columns and len(left) == len([r for r in got if r["doc_id"] is not None])
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    assert all(j not in left for (i, j), x in alike.items() if x >= 0.9)
    assert {j for j in sets if j not in left} <= {j for (i, j), x in alike.items() if x >= 0.6}
    assert sum(r["doc_id"] is None for r in got) == 1

    clean = pipeline.decontaminate(spark, kept, folder)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in got}
    assert clean.columns == columns and clean.count() == len(got)
    for r in collected(clean):
        hit = hit_words(texts[r["doc_id"]], items)[1]
        assert (r["text"] == texts[r["doc_id"]]) == (hit == 0) and hit_words(r["text"], items)[1] == 0
        assert hit_words(r["text"], [])[0] == hit_words(texts[r["doc_id"]], [])[0] - hit and r["n_chars"] == len(r["text"])

    safe = pipeline.redact(spark, clean, folder)
    texts = {r["doc_id"]: r["text"] for r in collected(clean)}
    changed = [r for r in collected(safe) if r["text"] != texts[r["doc_id"]]]
    assert safe.columns == columns and len(changed) == 1 and " [assign] end" in changed[0]["text"] and "abcdef123456" not in changed[0]["text"]

    P = pytest.importorskip("public_tokenizers")
    encoder = bpe.Encoder(bpe.Vocabulary.read(P.path("word_bpe_49k.json")))
    texts = {r["doc_id"]: r["text"] for r in collected(safe)}
    for r in collected(pipeline.tokens(spark, safe, folder)):
        ids, decoded = encoder.encode([texts[r["doc_id"]]])[0]
        assert (r["ids_sha256"], r["decoded_sha256"]) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (ids, decoded))


def test_run_is_the_stages_in_order(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "redact", "tokens"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, collected(docs))) == sorted(map(str, collected(corpus_pipeline.run(spark, folder))))


def test_empty_documents(spark, folder):
    docs = empty(spark.read.parquet(f"{folder}/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.agg(F.count("*")).first()[0] == 0, name
