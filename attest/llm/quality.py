"""Quality scores: a logistic regression over hashed word n-grams, learnt by follow-the-regularised-leader updates.

Tokens are runs of letters and digits, and runs of signs; features are hashed single tokens and pairs of neighbours,
where a token that repeats the one before it counts as one common "repeated" token. A text is the vector of
log(1 + count), scaled to length one; its score is the logistic of a sparse dot product. An empty or null text has no
features and scores the bias.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import flat, ftrl
from .common import materialise, per_row, remainder, sampled, table

BITS = 18
RATES = ftrl.Rates(alpha=1.0, beta=1.0, l1=0.05, l2=0.05)
KIND = flat.byte_classes(
    word_wide="0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", sign="!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~")
_REPEATED = np.uint64(0x5EED)
SHARD = 3_000  # rows that are learnt from together


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, index and value of every feature of a range of texts, by row and index; each row has length one."""
    t = flat.Tokens(data, offsets, KIND, flat.LOWER)
    row, h = t.row_of(), t.hashes
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    same_row = row[1:] == row[:-1]
    single = h.copy()
    single[1:][same_row & (h[1:] == h[:-1])] = _REPEATED
    pair = flat.mix(h[:-1] * np.uint64(3) + single[1:])[same_row]
    pair[(single[1:] == _REPEATED)[same_row]] = _REPEATED + np.uint64(1)
    shift = np.uint64(64 - bits)
    key = np.concatenate([
        (row << bits) | (flat.mix(single) >> shift).astype(np.int64),
        (row[1:][same_row] << bits) | (flat.mix(pair) >> shift).astype(np.int64)])
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    value = np.log1p(np.diff(np.append(first, len(key))))
    key = key[first]
    row = key >> bits
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(offsets) - 1))
    return row, key & ((1 << bits) - 1), (value / norm[row]).astype(np.float32)


def learn(labelled: DataFrame, id_col: str, text_col: str, label_col: str, shards: int = 4, bits: int = BITS,
          rates: ftrl.Rates = RATES) -> np.ndarray:
    """Weights of the model, the bias last.

    Rows without a label or an id are left out. Each shard learns apart, in the order of a hash of the id, and the
    weights are averaged; the caller bounds the rows.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")) \
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))

    def feature_rows():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = flat.texts(batch.column("text"))
            at, values = [], []
            for a, b in flat.pieces(offsets):
                row, index, value = features(data, offsets[a: b + 1], bits)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                for i in range(b - a):
                    at.append(index[cut[i]: cut[i + 1]].astype(np.int32).tobytes())
                    values.append(value[cut[i]: cut[i + 1]].tobytes())
            return pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("label"), pa.array(at, pa.binary()), pa.array(values, pa.binary())],
                ["id", "label", "at", "value"])
        return f

    def train(key, group):
        group = group.sort_by([("place", "ascending"), ("id", "ascending"), ("label", "ascending")])
        examples = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32).astype(float), y) for a, v, y in zip(
            group["at"].to_pylist(), group["value"].to_pylist(), group["label"].to_pylist())]
        w = ftrl.train(examples, 1 << bits, 2, rates)[0]
        return pa.table({"n": [len(examples)], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    place = F.xxhash64(F.lit("place"), F.col("id"))
    shards = per_row(rows, feature_rows, "id long, label int, at binary, value binary") \
        .withColumn("place", place).groupBy(F.pmod("place", F.lit(shards)).alias("shard")).applyInArrow(train, "n long, w binary")
    weights = np.zeros((1 << bits) + 1)
    total = 0
    for n, w in shards.collect():  # one vector of bounded size from each of a few shards
        weights += n * np.frombuffer(w, np.float32)
        total += n
    return (weights / max(total, 1)).astype(np.float32)


def score(df: DataFrame, text_col: str, weights: np.ndarray, bits: int = BITS, keep: str = "") -> DataFrame:
    """The kept columns (a schema string such as "doc_id long") and the score of each text, 0 to 1."""
    broadcast = df.sparkSession.sparkContext.broadcast(weights)
    names = [c.strip().split(" ")[0] for c in keep.split(",") if c.strip()]

    def scorer():
        w = broadcast.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = flat.texts(batch.column("__text"))
            logits = np.full(len(offsets) - 1, float(w[-1]))
            for a, b in flat.pieces(offsets):
                row, index, value = features(data, offsets[a: b + 1], bits)
                logits[a:b] += np.bincount(row, value * w[index], minlength=b - a)
            return pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(ftrl.probabilities(logits[None])[0])], [*names, "score"])
        return f

    return per_row(df.select(*names, F.col(text_col).alias("__text")), scorer, ", ".join([*([keep] if keep else []), "score double"]))


def quality(documents: DataFrame, labels: DataFrame, folds: int = 5, most: int = 12_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Learns from `labels.quality` of the documents whose crc32(doc_id) mod `folds` is not 0. Several labels of one
    document count as their mean, halves as 1; labels that are null or not 0 or 1 count as none. Documents without an
    id, repeated rows, empty and null texts are scored like any other. Without any label every score is 0.5.
    """
    ids = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1)) \
        .filter(F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != 0)) \
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("__label"))
    ids = materialise(sampled(ids, "doc_id", most), "quality-labels")  # at most some `most` pairs of numbers
    learnt = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    weights = learn(learnt, "doc_id", "text", "__label", -(-ids.count() // SHARD) or 1)
    scored = score(documents.select("doc_id", "text"), "text", weights, keep="doc_id long")
    return scored.select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality(table(spark, d, "documents"), table(spark, d, "labels"))
