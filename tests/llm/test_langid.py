import random
import zlib

import numpy as np
import pytest

from attest.llm import flat, langid

from .helpers import collected, documents, empty

WORDS = {"en": "the and of to that with for was is this".split(), "de": "der die und das nicht ein für über schön mit".split(),
         "fr": "le la les été où français avec pour être une".split()}


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(8)
    texts = [(" ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(3, 40))) + rnd.choice(["", " 12, 3!"]), lang)
             for lang in (rnd.choice(list(WORDS)) for _ in range(500))]
    return documents(spark, [*texts, ("123 456 !!", "en"), ("le la les", None)])


def test_ngrams_of_a_text_do_not_depend_on_its_neighbours():
    import pyarrow as pa

    def of(texts):
        data, offsets = flat.texts(pa.array(texts, pa.string()))
        return [dict(zip(at.tolist(), np.round(tf, 6).tolist())) for at, tf in langid.grams(data, offsets)]

    texts = ["Straße é", "", "ABC abc 1", "\U0001F600 x", None, "a" * 40_000]
    assert of(texts) == [of([t])[0] for t in texts]
    assert of(["ABC"]) == of(["abc"]) and of(["12 !!"]) == [{}] and of([""]) == [{}]


def test_predictions(docs):
    rows = collected(langid.language(docs))
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: (r["text"], r["lang"]) for r in collected(docs)}
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und" and truth[r["doc_id"]][1]]
    assert len(held) > 100 and np.mean([r["lang_pred"] == truth[r["doc_id"]][1] for r in held]) > 0.97
    for r in rows:
        text = truth[r["doc_id"]][0]
        name = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(name.encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
        assert r["lang_pred"] in {*WORDS, "und"}


def test_nothing_or_one_language_to_learn(docs, spark):
    assert collected(langid.language(empty(docs))) == []
    no = docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None, "lang")
    assert {(r["lang_pred"], r["score"]) for r in collected(langid.language(no))} == {("und", 0.0)}
    one = documents(spark, [(f"the word {i} here", "en") for i in range(30)])
    assert {r["lang_pred"] for r in collected(langid.language(one))} == {"en", "und"}
    two = documents(spark, [(" ".join(WORDS[x]), x) for x in ["en", "fr"] * 30])
    assert {r["lang_pred"] for r in collected(langid.language(two))} == {"en", "fr", "und"}


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(500, 3)) * 8  # far too sure
    y = np.array([rng.choice(3, p=np.exp(r / 8) / np.exp(r / 8).sum()) for r in z])
    t = langid.fit_temperature(z, y)
    assert 4 < t < 8.5
    assert langid.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_a_rare_language_is_learnt_beside_a_hot_one(spark):
    rnd = random.Random(2)
    said = lambda lang: " ".join(rnd.choice(WORDS[lang]) for _ in range(20))
    rows = [(i, said("de" if i % 200 == 7 else "en"), "de" if i % 200 == 7 else "en") for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    assert langid.share({"en": 3980, "de": 20}, 120) == 100 and langid.share({"a": 5, "b": 5}, 4) == 2 and langid.share({"a": 1}, 4) == 1
    picked = collected(langid.drawn(df, 120))
    assert sum(r["lang"] == "de" for r in picked) == 20 and 60 <= sum(r["lang"] == "en" for r in picked) <= 160
    assert sorted(r["id"] for r in picked) == sorted(r["id"] for r in collected(langid.drawn(df.repartition(7), 120)))
    assert langid.learn(df, most=12).langs == ("de", "en")
