import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.llm import flat, ftrl, quality

from .helpers import collected, documents, empty


def test_tokens_and_features_match_a_plain_reading():
    import pyarrow as pa

    texts = ["Ab ab!! c", None, "", "é é é x", "a\nb"]
    data, offsets = flat.texts(pa.array(texts))
    t = flat.Tokens(data, offsets, quality.KIND, flat.LOWER)
    assert np.diff(t.rows).tolist() == [4, 0, 0, 4, 2]
    assert t.hashes[0] == t.hashes[1] and len(set(t.hashes.tolist())) == 7
    row, index, value = quality.features(data, offsets)
    assert set(row.tolist()) == {0, 3, 4}
    for i in (0, 3, 4):
        assert abs(float((value[row == i] ** 2).sum()) - 1) < 1e-5
    alone = [quality.features(*flat.texts(pa.array([x]))) for x in ("é é é x",)][0]
    assert index[row == 3].tolist() == alone[1].tolist()


def test_learner_separates_and_drops_useless_weights():
    rng = np.random.default_rng(0)
    rows = [(np.array([0 if y else 1, 2 + int(rng.integers(50))]), np.array([0.7, 0.7]), y) for y in rng.integers(0, 2, 400).tolist()]
    w = ftrl.train(rows, 60, 2, ftrl.Rates(l1=0.5))[0]
    assert w[0] > 0.5 > -0.5 > w[1] and (w[2:60] == 0).mean() > 0.5
    many = ftrl.train([(np.array([y]), np.array([1.0]), y) for y in [0, 1, 2] * 100], 3, 3, ftrl.Rates())
    assert many.shape == (3, 4) and (many[:, :3].argmax(axis=0) == [0, 1, 2]).all()


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        good = rnd.random() < 0.7
        texts.append((" ".join(rnd.choice(vocabulary) + ("" if good else "!!") for _ in range(rnd.randint(5, 60))), "en"))
        labels.append((i, int(good), 0))
    df = documents(spark, texts)
    labels += [(None, 1, 0), (3, None, 0), (9999, 1, 0), labels[5], (6, 7, 0)]
    return df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rows_and_held_out_accuracy(data):
    df, labels = data
    rows = collected(quality.quality(df, labels))
    assert len(rows) == df.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.filter("quality in (0, 1)").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    for r in rows:
        name = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(name.encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_labels_held_out_do_not_matter(data, spark):
    df, labels = data
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda rows: sorted((str(r["doc_id"]), round(r["score"], 9)) for r in rows)
    assert score(collected(quality.quality(df, labels))) == score(collected(quality.quality(df, turned)))


def test_empty_tables(data):
    df, labels = data
    assert collected(quality.quality(empty(df), labels)) == []
    assert {r["score"] for r in collected(quality.quality(df, empty(labels)))} == {0.5}
