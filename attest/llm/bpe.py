"""BPE encoding and decoding with a given vocabulary, by batched numpy merge rounds.

The distinct words of many texts are encoded together: their symbols stand in one flat array, the pairs of neighbours
are looked up by binary search over the sorted keys of all merges, and in every round each unfinished word merges its
lowest-ranked pair everywhere it occurs. The vocabulary file (a tokenizer in JSON with a byte-level BPE model whose
words end in a suffix) is read once on the driver and broadcast; its size does not depend on the data.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import flat
from .bytebpe import classes
from .common import per_row, table

# The white space that the vocabulary's pattern knows, and its pattern for words.
SPACE = r"\t-\r \u0085   -     　"
WORDS = r"{letter}+|'s|'t|'re|'ve|'m|'ll|'d|{number}|[^{space}{letters}{numbers}]+"
CACHED = 100_000  # words whose ids a worker remembers
LATIN = 0x250  # texts below this character are split by a plain pattern, which is faster
LONG = 2048  # bytes of a word that has rounds of its own
NONE = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The visible character that stands for each byte: itself if printable, else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    tokens: tuple[str, ...]  # by id
    first: np.ndarray  # id of a byte inside a word
    last: np.ndarray  # id of a byte at its end
    keys: np.ndarray  # sorted left * 2 ** 20 + right of all merges
    ranks: np.ndarray
    merged: np.ndarray
    special: dict[str, int]

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, suffix = dict(model["vocab"]), model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max(*ids.values(), *special.values()) + 1)
        for token, i in (ids | special).items():
            tokens[i] = token
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]]
        left, right, merged = np.array(pairs, np.int64).T
        keys = (left << 20) | right
        order = np.argsort(keys, kind="stable")
        characters = byte_characters()
        return Vocabulary(
            tuple(tokens), np.array([ids[c] for c in characters], np.int32), np.array([ids[c + suffix] for c in characters], np.int32),
            keys[order], order.astype(np.int32), merged[order].astype(np.int32), special)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The places of pairs among the sorted keys; -1 where there is no such merge."""
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def _encode_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word. Pairs are kept by rank, so a round costs what it merges: only pairs beside a merge are looked up again."""
        n = len(word)
        symbols = self.first[np.frombuffer(word, np.uint8)].astype(np.int64)
        symbols[-1] = self.last[word[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        there = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[tuple[int, int]] = []

        def add(places: np.ndarray) -> None:
            at = self._rank(symbols[places], symbols[after[places]])
            places, at = places[at >= 0], at[at >= 0]
            order = np.argsort(at, kind="stable")
            places, at = places[order], at[order]
            cuts = np.flatnonzero(np.diff(at)) + 1
            for own, key in zip(np.split(places, cuts), at[np.append(0, cuts)].tolist() if len(at) else ()):
                if key not in waiting:
                    waiting[key] = []
                    heapq.heappush(ranks, (int(self.ranks[key]), key))
                waiting[key].append(own)

        add(np.arange(n - 1))
        while ranks:
            _, key = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(key)))
            places = places[there[places]]
            places = places[after[places] < n]
            places = places[((symbols[places] << 20) | symbols[after[places]]) == self.keys[key]]
            if not len(places):
                continue
            # Of a run of equal symbols every second pair merges, from the left.
            head = np.append(True, after[places[:-1]] != places[1:])
            run = np.arange(len(places)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            places = places[run % 2 == 0]
            gone = after[places]
            symbols[places] = self.merged[key]
            there[gone] = False
            after[places] = after[gone]
            inner = after[places] < n
            before[after[places[inner]]] = places[inner]
            beside = np.unique(np.concatenate([places[inner], before[places][before[places] >= 0]]))
            add(beside)
        return symbols[there].astype(np.int32)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (not empty)."""
        long = {i for i, w in enumerate(words) if len(w) > LONG}
        if long:
            short = iter(self.encode_words([w for i, w in enumerate(words) if i not in long]) if len(long) < len(words) else ())
            return [self._encode_long(w) if i in long else next(short) for i, w in enumerate(words)]
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        out: list[np.ndarray] = [symbols[:0]] * len(words)
        while len(symbols):
            key = (symbols[:-1].astype(np.int64) << 20) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), NONE)
            hit = (self.keys[at] == key) & (word[1:] == word[:-1])
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.minimum.reduceat(rank, starts)
            for i in np.flatnonzero(least == NONE):
                out[word[starts[i]]] = symbols[starts[i]: starts[i] + sizes[i]]
            going = np.repeat(least != NONE, sizes)
            chosen = (rank == np.repeat(least, sizes)) & going
            # Of a run of equal symbols every second pair merges, from the left.
            spot = np.flatnonzero(chosen)
            head = np.append(True, np.diff(spot) != 1) if len(spot) else np.zeros(0, bool)
            run = np.arange(len(spot)) - np.flatnonzero(head)[np.cumsum(head) - 1] if len(spot) else spot
            spot = spot[run % 2 == 0]
            symbols = symbols.copy()
            symbols[spot] = self.merged[at[spot]]
            going[spot + 1] = False
            symbols, word = symbols[going], word[going]
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as a vocabulary without a decoder gives them."""
        return " ".join([self.tokens[i] for i in ids])


def word_pattern(latin: bool) -> re.Pattern | regex.Pattern:
    """The pattern for words; for texts below LATIN with its letters and numbers written out."""
    if not latin:
        letters, numbers = classes()  # of the libraries' Unicode version, not that of the installed tables
        return regex.compile(WORDS.format(letter=f"[{letters}]", number=f"[{numbers}]", letters=letters, numbers=numbers, space=SPACE))
    letters, numbers = ("".join(chr(i) for i in range(LATIN) if unicodedata.category(chr(i))[0] == kind) for kind in "LN")
    return re.compile(WORDS.format(letter=f"[{letters}]", number=f"[{numbers}]", letters=letters, numbers=numbers, space=SPACE))


class Encoder:
    """Encodes and decodes texts; remembers the words it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.latin, self.all = word_pattern(True), None
        self.beyond = re.compile(f"[^\\0-{chr(LATIN - 1)}]")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") \
            if vocabulary.special else None
        self.numerals = tuple(map(str, range(len(vocabulary.tokens))))
        self.ids: dict[str | int, str] = {}
        self.decoded: dict[str | int, str] = {}

    def _split(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens between them."""
        out: list[str | int] = []
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                out.append(self.vocabulary.special[part])
            elif part:
                # Case is folded letter by letter: a final sigma is no special case.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                pattern = self.latin
                if self.beyond.search(part):
                    pattern = self.all = self.all or word_pattern(False)
                out += pattern.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids in decimal, joined by blanks, and what they decode to."""
        split = [self._split(t) for t in texts]
        if len(self.ids) > CACHED:
            self.ids, self.decoded = {}, {}
        new: set[str | int] = set().union(*split) - self.ids.keys()
        plain = [w for w in new if isinstance(w, str)]
        found = [(w, ids.tolist()) for w, ids in zip(plain, self.vocabulary.encode_words([w.encode() for w in plain]))] if plain else []
        for w, ids in [*found, *((w, [w]) for w in new if isinstance(w, int))]:
            self.ids[w] = " ".join([self.numerals[i] for i in ids])
            self.decoded[w] = self.vocabulary.decode(ids)
        return [(" ".join(map(self.ids.__getitem__, words)), " ".join(map(self.decoded.__getitem__, words))) for words in split]


_encoders: dict[str, Encoder] = {}  # of this worker, by the vocabulary's digest


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    key = hashlib.sha256(vocabulary.keys.tobytes() + "\n".join(vocabulary.tokens).encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def encode(df: DataFrame, vocabulary_path: str, keep: str, text_col: str = "text", ids: bool = False) -> DataFrame:
    """The kept columns, then n_tokens, ids_sha256 and decoded_sha256 of each text, and with `ids` the ids themselves.

    A null text is an empty one; it has no tokens. Repeated rows are encoded each.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path))
    names = [c.strip().split(" ")[0] for c in keep.split(",")]

    def encoder():
        e = encoder_of(vocabulary.value)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column("__text")
            _, offsets = flat.texts(column)
            counts, hashes, decoded, all_ids = [], [], [], []
            for a, b in flat.pieces(offsets):
                for numbers, text in e.encode([t or "" for t in column.slice(a, b - a).to_pylist()]):
                    counts.append(numbers.count(" ") + 1 if numbers else 0)
                    hashes.append(hashlib.sha256(numbers.encode()).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                    if ids:
                        all_ids.append(list(map(int, numbers.split())))
            arrays = [*(batch.column(n) for n in names), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)]
            return pa.RecordBatch.from_arrays(arrays + ([pa.array(all_ids, pa.list_(pa.int32()))] if ids else []),
                                              [*names, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)
        return f

    schema = f"{keep}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return per_row(df.select(*names, F.col(text_col).alias("__text")), encoder, schema)


def op2_bpe(spark: SparkSession, d: str, name: str = "word_bpe_49k.json") -> DataFrame:
    """n_tokens and the digests of ids and decoded text of every document."""
    import public_tokenizers

    return encode(table(spark, d, "documents"), public_tokenizers.path(name), "doc_id long")
