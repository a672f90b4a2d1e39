"""Benchmark decontamination by winnowing.

Of every window of neighbouring k-gram hashes the least is kept as a fingerprint, for documents and items alike. Texts
that share `window` words share a fingerprint, whatever stands around, so a join on fingerprints finds every shared
window; a hit is then extended word by word to the whole shared run. Items shorter than a window count as one window of
their own length; for each such length all k-grams of that length are fingerprints, which needs no extension.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import flat
from .common import materialise, per_row, table

WORD = flat.byte_classes(word_wide="0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
OFTEN = 8  # times that a fingerprint stands in one sequence and is still extended at each of them
BLOCK = 16_000_000  # bytes of item text that are broadcast at once
_STEP = np.uint64(0xD6E8FEB86659FD93)


def kgrams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words in a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h *= _STEP
        h += words[i: n + i]
    return flat.mix(h)


def winnowed(grams: np.ndarray, edges: np.ndarray, k: int, w: int) -> np.ndarray:
    """Which k-grams are fingerprints: the last least one of some window of `w` k-grams inside one row.

    edges: row i has words edges[i] .. edges[i + 1]; a row of fewer k-grams than a window has none.
    """
    n = len(grams)
    kept = np.zeros(n, bool)
    if n < w:
        return kept
    least = grams[: n - w + 1].copy()
    for i in range(1, w):
        np.minimum(least, grams[i: n - w + 1 + i], out=least)
    inside = np.zeros(n - w + 1, bool)  # windows that do not cross rows
    marks = np.zeros(n + 1, np.int64)
    first, last = edges[:-1], edges[1:] - (k - 1) - (w - 1)
    some = last > first
    np.add.at(marks, first[some], 1)
    np.add.at(marks, last[some], -1)
    inside[:] = np.cumsum(marks)[: n - w + 1] > 0
    open_ = inside.copy()
    for i in range(w - 1, -1, -1):
        hit = open_ & (grams[i: n - w + 1 + i] == least)
        kept[i: n - w + 1 + i] |= hit
        open_ &= ~hit
    return kept


@dataclass(frozen=True)
class Items:
    """Distinct word sequences of a block of items, and their fingerprints sorted by hash."""

    names: tuple[tuple[str, ...], ...]  # item ids of each sequence
    words: np.ndarray  # hashes of all words, one sequence after another
    spelled: tuple[bytes, ...]
    edges: np.ndarray
    prints: np.ndarray  # sorted
    at: np.ndarray  # the first word of each
    sequence: np.ndarray
    often: np.ndarray  # whether the fingerprint stands more than OFTEN times in its sequence
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # length: sorted hashes, sequence

    @staticmethod
    def of(rows: list[tuple[str, bytes]], window: int, k: int) -> Items:
        """rows: item id and text of each item, ids as text."""
        by_words: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in rows:
            data = np.frombuffer(text, np.uint8)
            t = flat.Tokens(data, np.array([0, len(data)]), WORD, flat.LOWER)
            lowered = text.translate(bytes(flat.LOWER))
            spelled = tuple(lowered[a:b] for a, b in zip(t.starts, t.ends))
            if spelled:
                by_words.setdefault(spelled, set()).add(name)
        sequences = sorted(by_words)
        text = b"\n".join(b" ".join(s) for s in sequences)
        lengths = np.array([len(s) for s in sequences], np.int64)
        data = np.frombuffer(text, np.uint8)
        t = flat.Tokens(data, np.array([0, len(data)]), WORD, flat.LOWER)
        edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        grams = kgrams(t.hashes, k)
        at = np.flatnonzero(winnowed(grams, edges, k, window - k + 1))
        at = at[np.argsort(grams[at], kind="stable")]
        sequence = np.repeat(np.arange(len(sequences)), lengths)
        order = np.lexsort((sequence[at], grams[at]))
        at = at[order]
        head = np.append(True, (grams[at[1:]] != grams[at[:-1]]) | (sequence[at[1:]] != sequence[at[:-1]])) if len(at) else np.zeros(0, bool)
        times = np.diff(np.append(np.flatnonzero(head), len(at)))
        often = np.repeat(times > OFTEN, times)
        kept = head | ~often  # one of those that repeat in a sequence stands for all
        at, often = at[kept], often[kept]
        short = {}
        for n in np.unique(lengths[lengths < window]):
            which = np.flatnonzero(lengths == n)
            h = np.concatenate([kgrams(t.hashes[edges[i]: edges[i + 1]], int(n)) for i in which])
            order = np.argsort(h, kind="stable")
            short[int(n)] = h[order], which[order]
        return Items(tuple(tuple(sorted(by_words[s])) for s in sequences), t.hashes, tuple(w for s in sequences for w in s), edges,
                     grams[at], at, sequence[at], often, short)

    def _matches(self, prints: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into hashes, index into prints) of equal values."""
        if not len(prints) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = np.searchsorted(prints, hashes), np.searchsorted(prints, hashes, side="right")
        n = high - low
        which = np.repeat(np.arange(len(hashes)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)

    def _repeated(self, t: flat.Tokens, window: int, here: np.ndarray, sequence: np.ndarray, row: np.ndarray | None, spelled) -> list[tuple[int, int, int]]:
        """Hits at fingerprints that repeat within a sequence: each window around them is looked up and verified once."""
        found: list[tuple[int, int, int]] = []
        for s in np.unique(sequence).tolist():
            at = np.unique(here[sequence == s])
            first, last = t.rows[row[at]], t.rows[row[at] + 1]
            around = np.unique(np.concatenate([at - i for i in range(window)]))
            low, high = np.searchsorted(around, np.maximum(first, at - window + 1)), np.searchsorted(around, np.minimum(at, last - window), side="right")
            marks = np.zeros(len(around) + 1, np.int64)
            np.add.at(marks, low[high > low], 1)
            np.add.at(marks, high[high > low], -1)
            starts = around[np.cumsum(marks)[:-1] > 0]
            words = self.words[self.edges[s]: self.edges[s + 1]]
            known, place = np.unique(kgrams(words, window), return_index=True)
            if not len(starts) or not len(known):
                continue
            grams = kgrams(t.hashes[starts[0]: starts[-1] + window], window)[starts - starts[0]]
            index = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            open_ = None
            for a, b in zip(starts[known[index] == grams].tolist(), (place[index[known[index] == grams]] + self.edges[s]).tolist()):
                if all(spelled(a + i) == self.spelled[b + i] for i in range(window)):
                    if open_ is not None and a <= open_[1] and row[a] == row[open_[0]]:
                        open_[1] = a + window
                        continue
                    if open_ is not None:
                        found.append((open_[0], open_[1], s))
                    open_ = [a, a + window]
            if open_ is not None:
                found.append((open_[0], open_[1], s))
        return found

    def hits(self, t: flat.Tokens, window: int, k: int) -> list[tuple[int, int, int]]:
        """(first word, end word, sequence) of every run of the tokens that an item window covers, runs of one row each."""
        found: list[tuple[int, int, int]] = []
        lowered = flat.LOWER
        edges, row = t.rows, None

        def spelled(i: int) -> bytes:
            return lowered[t.data[t.starts[i]: t.ends[i]]].tobytes()

        grams = kgrams(t.hashes, k)
        chosen = np.flatnonzero(winnowed(grams, edges, k, window - k + 1)) if len(self.prints) else np.zeros(0, np.int64)
        which, prints = self._matches(self.prints, grams[chosen])
        if len(which):
            row = t.row_of()
        reached: dict[tuple[int, int], int] = {}  # by sequence and diagonal: the end of the last run tried
        often = self.often[prints]
        found += self._repeated(t, window, chosen[which[often]], self.sequence[prints[often]], row, spelled)
        which, prints = which[~often], prints[~often]
        for here, there, s in zip(chosen[which].tolist(), self.at[prints].tolist(), self.sequence[prints].tolist()):
            if reached.get((s, here - there), -1) > here:
                continue
            first, last = edges[row[here]], edges[row[here] + 1]
            low, high = self.edges[s], self.edges[s + 1]
            a, b = here, there
            while a > first and b > low and t.hashes[a - 1] == self.words[b - 1] and spelled(a - 1) == self.spelled[b - 1]:
                a, b = a - 1, b - 1
            end, b_end = here, there
            while end < last and b_end < high and t.hashes[end] == self.words[b_end] and spelled(end) == self.spelled[b_end]:
                end, b_end = end + 1, b_end + 1
            reached[s, here - there] = max(end, here + 1)
            if end - a >= window:
                found.append((a, end, s))
        for n, (hashes, sequences) in self.short.items():
            grams = kgrams(t.hashes, n)
            where = np.flatnonzero(np.isin(grams, hashes))
            if not len(where):
                continue
            row = t.row_of() if row is None else row
            where = where[row[where] == row[where + n - 1]]
            which, at = self._matches(hashes, grams[where])
            for here, s in zip(where[which].tolist(), sequences[at].tolist()):
                if all(spelled(here + i) == self.spelled[self.edges[s] + i] for i in range(n)):
                    found.append((here, here + n, s))
        return found


def _blocks(items: DataFrame, size: int) -> list[list[tuple[str, bytes]]]:
    """Items in blocks of about `size` bytes, one block on the driver at a time if there are several."""
    block, held = [], 0
    for name, text in items.toLocalIterator():
        block.append((name, (text or "").encode()))
        held += len(block[-1][1]) + 64
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block: int = BLOCK, keep: str = "doc_id long",
                  text_col: str = "text", cut: bool = False) -> DataFrame:
    """The kept columns, then n_words, hits (first and end word of disjoint runs), and items (ids as text) of each row.

    With `cut` also `clean`: the text without its hit runs and the signs between their words.

    Nulls have no words; items without words are left out, and so are items without an id. Items are broadcast in
    blocks of `block` bytes; with several blocks each passes over the documents once and adds to what the earlier ones
    found, so memory does not grow with the benchmark. Equal items are matched once and all named.
    """
    spark = documents.sparkSession
    names = [c.strip().split(" ")[0] for c in keep.split(",")]
    schema = f"{keep}, n_words long, hits array<struct<start: long, end: long>>, items array<string>" + ", clean string" * cut
    rows = documents.select(*names, F.col(text_col).alias("__text"),
                            F.lit(None).cast("array<struct<start: long, end: long>>").alias("__hits"), F.lit(None).cast("array<string>").alias("__items"))
    named = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string"), F.col("text"))
    blocks = _blocks(named, block)
    current = next(blocks, [])
    while True:
        after = next(blocks, None)
        held = spark.sparkContext.broadcast(Items.of(current, window, k))

        def matcher(held=held, more=after is not None):
            found = held.value

            def f(batch: pa.RecordBatch) -> pa.RecordBatch:
                data, offsets = flat.texts(batch.column("__text"))
                before, items_before = batch.column("__hits").to_pylist(), batch.column("__items").to_pylist()
                counts, hits, items = [], [], []
                clean = batch.column("__text").to_pylist() if cut and not more else []
                for a, b in flat.pieces(offsets):
                    t = flat.Tokens(data, offsets[a: b + 1], WORD, flat.LOWER)
                    counts += np.diff(t.rows).tolist()
                    by_row: dict[int, list[tuple[int, int, int]]] = {}
                    for hit in found.hits(t, window, k):
                        by_row.setdefault(int(np.searchsorted(t.rows, hit[0], side="right")) - 1, []).append(hit)
                    for i in range(b - a):
                        mine = by_row.get(i, [])
                        runs = [(x - int(t.rows[i]), y - int(t.rows[i])) for x, y, _ in mine] + [(h["start"], h["end"]) for h in before[a + i] or ()]
                        hits.append([{"start": x, "end": y} for x, y in _merged(runs)])
                        if hits[-1] and clean:
                            clean[a + i] = _without(data, t, offsets[a + i], offsets[a + i + 1], int(t.rows[i]), hits[-1])
                        items.append(sorted({n for *_, s in mine for n in found.names[s]} | set(items_before[a + i] or ())))
                arrays = [batch.column(n) for n in names] + [pa.array(counts, pa.int64())] * (not more) + [batch.column("__text")] * more
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                return pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(hits, kind), pa.array(items, pa.list_(pa.string())), *([pa.array(clean, pa.string())] if cut and not more else [])],
                    [*names, "__text", "__hits", "__items"] if more else [*names, "n_words", "hits", "items", *["clean"] * cut])
            return f

        if after is None:
            return per_row(rows, matcher, schema)
        rows = materialise(per_row(rows, matcher, f"{keep}, __text string, __hits array<struct<start: long, end: long>>, __items array<string>"),
                           "benchmark-block")
        current = after


def _without(data: np.ndarray, t: flat.Tokens, start: int, end: int, first: int, hits: list[dict]) -> str:
    """The text of data[start:end], whose first token is number `first`, without the hit runs."""
    kept, at = [], start
    for h in hits:
        kept.append(data[at: t.base + int(t.starts[first + h["start"]])].tobytes())
        at = t.base + int(t.ends[first + h["end"] - 1])
    return b"".join([*kept, data[at:end].tobytes()]).decode()


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def op7_winnow(spark: SparkSession, d: str) -> DataFrame:
    """Words of every document inside a ten-word window of a benchmark item."""
    found = contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
