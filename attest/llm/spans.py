"""Substring dedup by sliding sentence spans.

A text is cut into sentences; every run of several consecutive sentences is hashed, from each sentence on and up to each
sentence, and runs that occur more than once anywhere are found by a global join. All their occurrences but the first,
by document and place, are covered, and covered sentences are removed.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import flat
from .common import materialise, per_row, released, table

LONG = 20  # words of a sentence that is not cut, and of a part of a longer one
NEAR = 4  # words on each side that a cut of a long sentence looks at
# Scripts that write words without blanks: each character counts as a word, with the stops behind it.
_DENSE = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff0f\uff1a-\uff20\uff61-\uff9f\U00020000-\U0003ffff"
_STOPS = "\u3002\uff01\uff1f\uff0e\uff61"  # end a sentence whatever follows
_MARKS = "[\u0e30-\u0e3a\u0e47-\u0e4e\u0eb0-\u0ebc\u0ec8-\u0ecd\u102b-\u103e\u17b4-\u17d3\u3099\u309a]"
_WORD = re.compile(rf"[{_DENSE}](?:{_MARKS}|[{_STOPS}\u300d\u300f\u201d\uff09])*|[^\s{_DENSE}]+")
_BLANKS = re.compile(r"\S+")  # the same words where no such character stands
_DENSE_ONE = re.compile(f"[{_DENSE}]")
_STOP = re.compile(rf"[{_STOPS}][\u300d\u300f\u201d\uff09]*$")
_ENDS = frozenset(".!?\u2026\u061f\u06d4\u0964\u0965\u0589\u1362\u1367\u104b\u17d4\u0f0d" + _STOPS)  # end a sentence before white space


class _Hashes(dict):
    """Hashes of words, the words met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode())
        return found


_hashes = _Hashes()


def _least(words: list[str]) -> np.ndarray:
    """Places of words that, with the word before them, have a hash below those of the NEAR words before and not above
    those of the NEAR words behind: the same words have the same places wherever they stand."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    h[1:] += flat.mix(h[:-1])
    h = flat.mix(h)
    n = len(h) - 2 * NEAR
    if n <= 0:
        return np.zeros(0, np.int64)
    middle = h[NEAR: NEAR + n]
    least = np.ones(n, bool)
    for k in range(NEAR):
        least &= (middle < h[k: k + n]) & (middle <= h[NEAR + 1 + k: NEAR + 1 + k + n])
    return np.flatnonzero(least) + NEAR


def sentences(text: str, long: int = LONG) -> list[tuple[int, int, str, int]]:
    """(start, end, words joined by blanks, number of words) of each sentence; together they are the whole text.

    A sentence ends after a full stop, question or exclamation mark before white space, or at a line end; the marks of
    Chinese and Japanese need no white space. Sentences of more than `long` words are cut at the words of `_least` that
    see only words of their sentence, and where no such word comes, after `long` words. The white space behind belongs to
    a sentence. Sentences without words belong to the one before.
    """
    words: list[str] = []
    places: list[int] = []
    first = [0]  # words that begin a sentence
    at, closing = 0, False
    dense = not text.isascii() and _DENSE_ONE.search(text) is not None
    for m in (_WORD if dense else _BLANKS).finditer(text):
        start, word = m.start(), m[0]
        if closing and (start > at or _STOP.search(words[-1])) or "\n" in text[at: start]:
            if words:
                first.append(len(words))
        words.append(word)
        places.append(start)
        at = m.end()
        last = word[-1]
        closing = last in _ENDS or dense and last > "\u2000" and _STOP.search(word) is not None
    if not words:
        return []
    first.append(len(words))
    cuts, least = [], None
    for a, b in zip(first, first[1:]):
        if b - a <= long:
            cuts.append(a)
            continue
        if least is None:
            least = _least(words)
        inner = least[np.searchsorted(least, a + 1 + NEAR): np.searchsorted(least, b - NEAR)].tolist()
        for x, y in zip([a, *inner], [*inner, b]):
            cuts += range(x, y, long)
    cuts.append(len(words))
    places.append(len(text))
    places[0] = 0
    return [(places[a], places[b], " ".join(words[a:b]), b - a) for a, b in zip(cuts, cuts[1:])]


def runs(units: list[tuple[int, int, str, int]], least: int, words: int) -> set[tuple[int, int]]:
    """(first, end) of the runs: for each sentence the shortest run from it on, and the shortest up to it, that has at
    least `least` sentences and `words` words."""
    n, total = len(units), [0]
    for unit in units:
        total.append(total[-1] + unit[3])
    found = set()
    end = 0
    for first in range(n):
        end = max(end, first + least)
        while end <= n and total[end] - total[first] < words:
            end += 1
        if end > n:
            break
        found.add((first, end))
    first = n
    for end in range(n, 0, -1):
        first = min(first, end - least)
        while first >= 0 and total[end] - total[first] < words:
            first -= 1
        if first < 0:
            break
        found.add((first, end))
    return found


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def occurrences(documents: DataFrame, least: int = 2, words: int = 12, long: int = LONG) -> DataFrame:
    """doc_id, text_hash, first, n (sentences), and h1 and h2 (hash of the words) of every run of every document.

    One row more for each document has its number of sentences as n, and no hash.
    """

    def finder():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, keys, firsts, counts, digests, documents_at = [], [], [], [], [], []
            texts = batch.column("text")
            names, whole = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            digest = xxhash.xxh3_128_digest
            for at in range(0, batch.num_rows, 64):
                for name, key, text in zip(names[at: at + 64], whole[at: at + 64], texts.slice(at, 64).to_pylist()):
                    units = sentences(text or "", long)
                    said = [u[2] for u in units]
                    found = sorted(runs(units, least, words))
                    documents_at.append(len(ids))
                    ids += [name] * (len(found) + 1)
                    keys += [key] * (len(found) + 1)
                    firsts.append(0)
                    counts.append(len(units))
                    digests.append(bytes(16))
                    for first, end in found:
                        firsts.append(first)
                        counts.append(end - first)
                        digests.append(digest(" ".join(said[first:end]).encode()))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            none = np.zeros(len(ids), bool)
            none[documents_at] = True
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(firsts, pa.int32()), pa.array(counts, pa.int32()),
                                               pa.array(h[:, 0], mask=none), pa.array(h[:, 1], mask=none)], ["doc_id", "text_hash", "first", "n", "h1", "h2"])
        return f

    return per_row(documents.select("doc_id", "text", _text_hash()), finder, "doc_id long, text_hash long, first int, n int, h1 long, h2 long")


def covered(documents: DataFrame, least: int = 2, words: int = 12, long: int = LONG) -> DataFrame:
    """doc_id, text_hash, n_sentences and spans (first and end sentence) of the runs that repeat an earlier one, one row for each document.

    Runs are equal if their words are, whatever white space stands between; they are compared by a 128-bit hash.
    The first occurrence is that of the least (doc_id, hash of the text, place). Documents without an id come before all others.
    """
    found = materialise(occurrences(documents, least, words, long), "sentence-runs")
    run = found.filter("h1 is not null")
    place = F.struct(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("first").alias("p"))
    first = materialise(run.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("kept"))
                        .filter("times > 1").select("h1", "h2", "kept"), "repeated-runs")
    again = run.join(first, ["h1", "h2"]).filter(~(F.col("doc_id").eqNullSafe(F.col("kept.d")) & (F.col("text_hash") == F.col("kept.h")) & (F.col("first") == F.col("kept.p"))))
    span = F.struct(F.col("first").alias("first"), (F.col("first") + F.col("n")).alias("end"))
    rows = again.select("doc_id", "text_hash", F.lit(None).cast("int").alias("n"), span.alias("span")) \
        .union(found.filter("h1 is null").select("doc_id", "text_hash", "n", F.lit(None)))
    out = materialise(rows.groupBy("doc_id", "text_hash").agg(F.max("n").alias("n_sentences"), F.collect_set("span").alias("spans")), "repeated-spans")
    released(found)
    released(first)
    return out


def dedup(documents: DataFrame, least: int = 2, words: int = 12, long: int = LONG) -> DataFrame:
    """doc_id, text without covered sentences, n_sentences, n_removed and removed (first and end sentence of each part).

    doc_id and the text name a document, also without an id; rows that repeat both are copies at the same place and lose
    the same, and a run is not a repeat of itself in them. Null and empty texts have no sentences and stay as they are. Only
    texts that lose something are cut into sentences again.
    """
    spans = covered(documents, least, words, long)
    joined = documents.select("doc_id", F.col("text").alias("__text"), _text_hash()).join(
        spans.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}), (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")

    def cutter():
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            column, counts = batch.column("__text"), batch.column("n_sentences").cast(pa.int64())
            merged = [_merged([(s["first"], s["end"]) for s in found or ()]) for found in batch.column("spans").to_pylist()]
            changed = [i for i, parts in enumerate(merged) if parts]
            if changed:
                texts = column.to_pylist()
                for i in changed:
                    units, out, at = sentences(texts[i], long), [], 0
                    for a, b in merged[i]:
                        out.append(texts[i][at: units[a][0]])
                        at = units[b - 1][1]
                    texts[i] = "".join([*out, texts[i][at:]])
                column = pa.array(texts, pa.string())
            gone = pa.array([sum(b - a for a, b in parts) for parts in merged], pa.int64())
            parts = pa.array([[{"first": a, "end": b} for a, b in own] for own in merged], kind)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), column, counts, gone, parts], ["doc_id", "text", "n_sentences", "n_removed", "removed"])
        return f

    return per_row(joined.select("doc_id", "__text", "n_sentences", "spans"), cutter,
                   "doc_id long, text string, n_sentences long, n_removed long, removed array<struct<first: long, end: long>>")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def op6_spans(spark: SparkSession, d: str) -> DataFrame:
    return dedup(table(spark, d, "documents")).select("doc_id", "text", "n_sentences", "n_removed", F.to_json("removed").alias("removed"))
