"""Spelling variants: words one edit apart, found by a relational trie frontier.

Words are the paths of tries in an edge table (trie, node, label, child). A frontier of states (word, position, node,
edits) is joined with the edges of one level after the other: a state either reads a label as it stands in its word, or
spends its one edit inside it; states that reach the end of a path with one edit are neighbours.

A pair of words one edit apart agrees either in the first half of the shorter word or in its last half. So there is a trie
over the words, for pairs that agree in front, and one over the reversed words, and each is entered below its first half:
the first level of a trie leads to all words of one length with one first half. A state of a word looks only for words of its
own length with a larger character, and for words that lack one of its characters; the other direction is the same pair. An edit
is spent where word and path first differ, so that every pair is found once.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialise, released, small_batches, table

RUN = re.compile("[a-zÀ-ÿ]+")  # of a text whose A-Z are lower case
EVERY = 97  # runs of which one loses a character
LEAST_POINTS, LEAST_TIMES = 5, 3
COUNTED = 200_000  # words that a task counts before it gives them out
LONG = 1 << 20  # characters of a text that is read run by run
RATIO = 2  # times a word's form is more frequent, at least


# --- words --------------------------------------------------------------------------------------


def _runs(text: str) -> Counter:
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes: only A-Z change
    if len(lower) <= LONG:
        return Counter(RUN.findall(lower))
    return Counter(m[0] for m in RUN.finditer(lower))


def misspelt(run: str, key: bytes, start: int) -> str:
    """The run, without one character if the CRC-32 of key and run says so; `start` is the CRC-32 of the key."""
    h = zlib.crc32(run.encode(), start)
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def run_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """word and n: how often the words of all texts occur, of LEAST_POINTS characters and LEAST_TIMES occurrences at least.

    A word is a run of letters A-Z (in lower case) and U+00C0 to U+00FF, misspelt by a rule of doc_id and run: a null doc_id counts
    as an empty text. Null texts have no words; repeated rows count each. Counts are summed in every task before they are shuffled.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("__text")
            for i, name in enumerate(ids):
                text = texts[i].as_py()
                if not text:
                    continue
                key = f"{'' if name is None else name}:".encode()
                start = zlib.crc32(key)
                for run, n in _runs(text).items():
                    word = misspelt(run, key, start)
                    if len(word) >= LEAST_POINTS:
                        counts[word] += n
                if len(counts) >= COUNTED:
                    yield _counted(counts)
                    counts = Counter()
        if counts:
            yield _counted(counts)

    small_batches(documents.sparkSession)
    found = documents.select("doc_id", F.col(text_col).alias("__text")).mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


# --- tries --------------------------------------------------------------------------------------


def cuts(longest: int) -> list[int]:
    """Characters behind the first half at which the levels of a trie end, up to a length.

    Levels of two characters, as few words agree in more than half; later ones double, so that long words need few levels.
    """
    out, step = [0], 2
    while out[-1] < longest:
        out.append(out[-1] + step)
        if len(out) > 8:
            step *= 2
    return out


def _depth(length: Column, reverse: Column, level: int, at: list[int]) -> Column:
    """The characters of a node of a level: the half that all below it share, and the levels down to it."""
    half = F.floor(length / 2).cast("int")
    return F.least(F.when(reverse, length - half).otherwise(half) + F.lit(at[level]), length)


def edges(words: DataFrame, at: list[int]) -> DataFrame:
    """level, reverse, length, node, label, child and n: the distinct edges of the tries of all words (word, n).

    A trie is named by the direction and the length of its words, a node by the characters that lead to it; n is the
    number of occurrences of the word that ends at the child, else null.
    """
    both = words.select("word", "n", F.char_length("word").alias("length"), F.explode(F.array(F.lit(False), F.lit(True))).alias("reverse")) \
        .withColumn("word", F.when(F.col("reverse"), F.reverse("word")).otherwise(F.col("word")))
    steps = []
    for level in range(len(at) - 1):
        a, b = (_depth(F.col("length"), F.col("reverse"), level + k, at) for k in (0, 1))
        steps.append(F.when(a < b, F.struct(F.lit(level).alias("level"), F.substring("word", F.lit(1), a).alias("node"), F.substring("word", a + 1, b - a).alias("label"),
                                            F.substring("word", F.lit(1), b).alias("child"), F.when(b == F.col("length"), F.col("n")).alias("n"))))
    rows = both.select("reverse", "length", F.explode(F.array_compact(F.array(*steps))).alias("e")).select("reverse", "length", "e.*")
    return rows.groupBy("level", "reverse", "length", "node", "label", "child").agg(F.max("n").alias("n"))


def frontier(words: DataFrame) -> DataFrame:
    """The states before the first level: reverse, length (of the words looked for), word, n, position, node and edits.

    A word looks for words of its own length, and for words that are one shorter.
    """
    own = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(own, own - 1)).alias("length")).filter(F.col("length") > 0)
    rows = rows.withColumn("reverse", F.explode(F.array(F.lit(False), F.lit(True)))) \
        .withColumn("word", F.when(F.col("reverse"), F.reverse("word")).otherwise(F.col("word")))
    start = _depth(F.col("length"), F.col("reverse"), 0, [0])
    return rows.select("reverse", "length", "word", "n", start.alias("position"), F.substring("word", F.lit(1), start).alias("node"), F.lit(0).alias("edits"))


KEY = ("reverse", "length", "node")


def advance(states: DataFrame, level: DataFrame) -> DataFrame:
    """The states that read one label of a level's edges from the nodes where they stand, with `at`, the child's n.

    What of the word is read equals the label; or else it has one character less or, among words of one length, another
    and smaller one, and no edit has been spent before.
    """
    size = F.char_length("label")
    read = F.substring("word", F.col("position") + 1, size)
    shorter = F.char_length("word") > F.col("length")
    more = F.substring("word", F.col("position") + 1, size + 1)
    exact = F.col("label") == read
    fresh = (F.col("edits") == 0) & ~exact
    replaced = fresh & ~shorter & (F.col("label") > read) & (F.levenshtein("label", read, 1) == 1)
    # One character longer and one edit apart: the label lacks one of what is read.
    deleted = fresh & shorter & (F.char_length(more) == size + 1) & (F.levenshtein("label", more, 1) == 1)
    met = states.join(level.select(*KEY, "label", "child", F.col("n").alias("at")), list(KEY)).where(exact | replaced | deleted)
    return met.select("reverse", "length", "word", "n", (F.col("position") + size + F.when(deleted, 1).otherwise(0)).cast("int").alias("position"),
                      F.col("child").alias("node"), F.when(exact, F.col("edits")).otherwise(1).cast("int").alias("edits"), "at")


def neighbours(words: DataFrame) -> DataFrame:
    """a, b, n_a and n_b of all pairs of the words (word, n) that one insertion, deletion or replacement makes equal, each once.

    Words must be distinct. Every level is written out, and those before it are given up.
    """
    longest = words.agg(F.max(F.char_length("word"))).first()[0] or 1
    at = cuts(longest - longest // 2)
    tries = materialise(edges(words, at), "variant-edges")
    states, found, last = frontier(words), [], None
    for level in range(len(at) - 1):
        met = materialise(advance(states, tries.filter(F.col("level") == level)), f"variant-states-{level}")
        # At the end of a path: one edit is spent, or the last character is the one to delete.
        ended = met.filter((F.col("at").isNotNull()) & ((F.col("edits") == 1) | (F.col("position") < F.char_length("word"))))
        found.append(materialise(ended.select("reverse", "length", F.col("word").alias("a"), F.col("node").alias("b"), F.col("n").alias("n_a"), F.col("at").alias("n_b")), f"variant-pairs-{level}"))
        if last is not None:
            released(last)
        last, states = met, met.filter(F.col("at").isNull()).drop("at")
    pairs = reduce(DataFrame.union, found)
    forth = [F.when(F.col("reverse"), F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("a", "b")]
    # What agrees in the first half, too, is found there.
    half = F.floor(F.col("length") / 2).cast("int")
    known = F.col("reverse") & (F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half))
    return pairs.select(*forth, "reverse", "length", "n_a", "n_b").filter(~known).select("a", "b", "n_a", "n_b")


# --- forms --------------------------------------------------------------------------------------


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words (word, n).

    n_near counts the words one edit apart. A word's form is the most frequent of them, the first in code-point order of
    equals, if it is RATIO times as frequent as the word; its root is where forms lead to, the word itself without one.
    """
    words = words.select("word", "n")
    pairs = neighbours(words)
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")) \
        .union(pairs.select("b", "a", "n_a"))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("m"), F.col("other").alias("w"))).alias("best"))
    often = -F.col("best.m") >= RATIO * F.col("n")
    rows = materialise(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.w")).alias("form"), F.when(often, -F.col("best.m")).alias("form_n")), "variant-forms")
    # Occurrences at least double with each form, so ways are short; each round halves them.
    up = materialise(rows.filter("form is not null").select("word", F.col("form").alias("root")), "variant-up")
    while not (further := up.join(up.select(F.col("word").alias("root"), F.col("root").alias("above")), "root", "left")).filter("above is not null").isEmpty():
        before, up = up, materialise(further.select("word", F.coalesce("above", "root").alias("root")), "variant-up")
        released(before)
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, d: str) -> DataFrame:
    """Spelling variants of all words of `documents`; see `run_counts` and `variants`.

    Null and empty texts have no words, repeated rows count each, runs of any length are words, ties go to the first word in
    code-point order, and an empty table gives no rows.
    """
    return variants(materialise(run_counts(table(spark, d, "documents")), "variant-words"))
