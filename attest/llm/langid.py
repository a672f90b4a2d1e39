"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased and everything else counts as one blank; n-grams of one to three characters are hashed. A text
is the vector of log(1 + count) times the inverse document frequency, scaled to length one. The weights are learnt by
follow-the-regularised-leader updates with elastic-net penalties, and the softmax is calibrated by one temperature,
fitted on learning rows that the weights have not seen.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import flat, ftrl
from .common import materialise, per_row, remainder, small_batches, table

BITS = 16
SHARD = 3_000
RATES = ftrl.Rates(alpha=2.0, beta=1.0, l1=0.02, l2=0.02, epochs=2, updates=6_000)
UNKNOWN = "und"
_PRIMES = [np.uint32(p) for p in (2654435761, 2246822519, 3266489917)]
_fold: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """What each character below U+10000 counts as: a letter's lower case, else a blank."""
    if not _fold:
        table = np.full(1 << 16, 32, np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _fold.append(table)
    return _fold[0]


def grams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS):
    """For each text of a range: (distinct hashed n-grams, log(1 + count))."""
    base, end = int(offsets[0]), int(offsets[-1])
    part = data[base:end]
    points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    edges = leads[offsets - base]
    low = points < (1 << 16)
    c = np.where(low, _letters()[np.where(low, points, 0)], points)
    shift = np.uint32(32 - bits)
    blank = c == 32
    one = c * _PRIMES[0]
    two = (one[:-1] ^ (c[1:] + np.uint32(7)) * _PRIMES[1]) * _PRIMES[2]
    three = (two[:-1] ^ (c[2:] + np.uint32(11)) * _PRIMES[0]) * _PRIMES[1]
    one = np.where(blank, 0, one * _PRIMES[1]) >> shift
    two = np.where(blank[1:] & blank[:-1], 0, two) >> shift
    three = np.where(blank[1:-1] & (blank[2:] | blank[:-2]), 0, three) >> shift
    hashed = [h.astype(np.uint16 if bits <= 16 else np.uint32) for h in (one, two, three)]
    for a, b in zip(edges[:-1], edges[1:]):
        h = np.concatenate([x[a: max(b - n, a)] for n, x in enumerate(hashed)])
        if len(h) < 1 << 14:
            h.sort()
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            at, count = h[first].astype(np.int64), np.diff(np.append(first, len(h)))
        else:
            count = np.bincount(h, minlength=1 << bits)
            at = np.flatnonzero(count)
            count = count[at]
        if len(at) and at[0] == 0:  # blanks
            at, count = at[1:], count[1:]
        yield at, np.log1p(count)


def _scaled(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = tf * idf[at]
    norm = np.sqrt(v @ v)
    return v / norm if norm > 0 else v


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    weights: np.ndarray  # (languages, buckets + 1), the bias last
    idf: np.ndarray
    temperature: float


def _document_frequency(rows: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts that hold each n-gram, over all rows."""

    small_batches(rows.sparkSession)

    def count(batches):
        n, total = 0, np.zeros(1 << bits, np.int64)
        for batch in batches:
            data, offsets = flat.texts(batch.column("text"))
            for a, b in flat.pieces(offsets):
                for at, _ in grams(data, offsets[a: b + 1], bits):
                    total[at] += 1
            n += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], ["gram", "n"])

    found = rows.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    df, n = np.zeros(1 << bits, np.int64), 0
    for gram, k in found.collect():  # at most one row for each bucket
        if gram < 0:
            n = k
        else:
            df[gram] = k
    return n, df


def share(counts: dict[str, int], most: int) -> int:
    """Rows of a language that are learnt from at most, so that all languages together have about `most`; one at least."""
    left, rest = most, sorted(counts.values())
    while rest and rest[0] * len(rest) <= left:
        left -= rest.pop(0)
    return max(1, left // len(rest)) if rest else max(counts.values(), default=1)


def drawn(rows: DataFrame, most: int) -> DataFrame:
    """All rows of languages with no more than their `share`, and about that many of every other language, by a hash of the id.

    Ten more of a language are drawn, so that chance leaves none out. The same ids are picked however the rows are dealt out.
    """
    counts = dict(rows.groupBy("lang").count().collect())  # one row for each class of the model
    if sum(counts.values()) <= most:
        return rows
    each = share(counts, most)
    near = rows.sparkSession.createDataFrame([(lang, int(min(1.0, (each + 10) / n if n > each else 1.0) * (1 << 62))) for lang, n in counts.items()], "lang string, near long")
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 62))
    return rows.join(F.broadcast(near), "lang").filter(place < F.col("near")).select("id", "text", "lang")


def learn(rows: DataFrame, most: int = 12_000, bits: int = BITS, rates: ftrl.Rates = RATES) -> Model | None:
    """A model of the rows (id, text, lang); None without any row that has a language.

    Document frequencies are counted over all rows. The weights are learnt from about `most` rows at most, drawn per
    language (see `drawn`), a sixth of which only fits the temperature; shards learn apart and are averaged.
    """
    n, df = _document_frequency(rows, bits)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    some = drawn(rows, most)

    def feature_rows():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = flat.texts(batch.column("text"))
            at, tf = [], []
            for a, b in flat.pieces(offsets):
                for index, value in grams(data, offsets[a: b + 1], bits):
                    at.append(index.astype(np.int32).tobytes())
                    tf.append(value.astype(np.float32).tobytes())
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array(at, pa.binary()), pa.array(tf, pa.binary())],
                                              ["id", "lang", "at", "tf"])
        return f

    spark = rows.sparkSession
    some = materialise(per_row(some, feature_rows, "id long, lang string, at binary, tf binary")
                       .withColumn("place", F.xxhash64(F.lit("place"), F.col("id"))), "language-features")
    counts = {lang: k for lang, k in some.groupBy("lang").count().collect()}  # bounded by `most`
    langs = tuple(sorted(counts))
    shards = -(-sum(counts.values()) // SHARD)
    calibrating = F.pmod(F.shiftright("place", 20), F.lit(6)) == 0

    def examples(group) -> list[tuple[np.ndarray, np.ndarray, int]]:
        out = []
        for at, tf, lang in zip(group["at"].to_pylist(), group["tf"].to_pylist(), group["lang"].to_pylist()):
            at = np.frombuffer(at, np.int32)
            out.append((at, _scaled(at, np.frombuffer(tf, np.float32).astype(float), idf), langs.index(lang)))
        return out

    def train(key, group):
        rows = examples(group.sort_by([("place", "ascending"), ("id", "ascending"), ("lang", "ascending")]))
        w = ftrl.train(rows, 1 << bits, len(langs), rates)
        return pa.table({"n": [len(rows)], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    k = 1 if len(langs) == 2 else len(langs)
    weights, total = np.zeros((k, (1 << bits) + 1)), 0
    for m, w in some.filter(~calibrating).groupBy(F.pmod("place", F.lit(shards)).alias("shard")) \
            .applyInArrow(train, "n long, w binary").toLocalIterator():
        weights += m * np.frombuffer(w, np.float32).reshape(weights.shape)
        total += m
    weights /= max(total, 1)
    held = spark.sparkContext.broadcast(weights.astype(np.float32))

    def logits(batches):
        for batch in batches:
            rows = examples(batch)
            found = [(held.value[:, at] @ v + held.value[:, -1]).astype(float).tolist() for at, v, _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), pa.array([y for *_, y in rows], pa.int32())], ["logits", "label"])

    fitted = some.filter(calibrating).mapInArrow(logits, "logits array<double>, label int").collect()  # a sixth of `most`
    temperature = fit_temperature(np.array([r[0] for r in fitted]).reshape(-1, k), np.array([r[1] for r in fitted], int))
    return Model(langs, held.value, idf, temperature)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, searched on a grid of powers; 1 without rows."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        p = ftrl.probabilities(logits.T / t)
        p = p if len(p) > 1 else np.stack([1 - p[0], p[0]])
        return -np.log(np.maximum(p[labels, np.arange(len(labels))], 1e-12)).mean()

    return float(min(np.exp(np.linspace(-2, 2, 41)), key=loss))


def predict(df: DataFrame, model: Model | None, keep: str, id_first: bool = True) -> DataFrame:
    """The kept columns of rows with a column `text`, then lang_pred and score."""
    broadcast = df.sparkSession.sparkContext.broadcast(model)
    names = [c.strip().split(" ")[0] for c in keep.split(",")]

    def predictor():
        m = broadcast.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = flat.texts(batch.column("text"))
            langs, scores = [], []
            for a, b in flat.pieces(offsets):
                for i, (at, tf) in enumerate(grams(data, offsets[a: b + 1]), a):
                    text = data[offsets[i]: offsets[i + 1]].tobytes().decode("utf-8")
                    if m is None or not any(map(str.isalpha, text)):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    z = (m.weights[:, at] @ _scaled(at, tf, m.idf) + m.weights[:, -1]) / m.temperature
                    p = ftrl.probabilities(z)
                    p = p if len(p) > 1 else np.array([1 - p[0], p[0]]) if len(m.langs) == 2 else np.ones(1)
                    best = int(p.argmax())
                    langs.append(m.langs[best])
                    scores.append(float(p[best]))
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                              [*names, "lang_pred", "score"])
        return f

    return per_row(df.select(*dict.fromkeys([*names, "text"])), predictor, f"{keep}, lang_pred string, score double")


def learning_rows(documents: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Rows to learn from: with an id, a text and a language, and not held out."""
    return documents.filter(remainder("doc_id", folds) != held_out) \
        .filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()) \
        .select(F.col("doc_id").alias("id"), "text", "lang")


def language(documents: DataFrame, folds: int = 3, held_out: int = 1, most: int = 12_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learns from rows with an id, a text and a language whose crc32(doc_id) mod `folds` is not `held_out`. A text that
    is null or holds no letter, and any text if nothing could be learnt, is `und` with score 0. Equal probabilities go
    to the language first in order. Repeated rows are predicted each.
    """
    model = learn(learning_rows(documents, folds, held_out), most)
    return predict(documents, model, "doc_id long").select(
        "doc_id", (remainder("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score")


def op3_language(spark: SparkSession, d: str) -> DataFrame:
    return language(table(spark, d, "documents"))
