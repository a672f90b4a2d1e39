"""Numpy kernels over the flat bytes of many texts at once.

A batch of texts is one byte array with offsets, as Arrow holds it. Tokens are found by byte class, and every token is
hashed from one running polynomial hash, so no text becomes a Python string and no loop runs over words.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 500_000  # bytes of text worked on at once; a longer text comes alone
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64, kept between calls up to a few pieces."""
    kept = _powers.get(str(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, PIECE), base, np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if n <= 4 * PIECE:
            _powers[str(base)] = kept
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a finaliser in the manner of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = pa.array(column.fill_null("")) if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.type == pa.large_string()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64) if len(offsets) else np.zeros(1, np.int64)


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `size` bytes, whole texts only."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


class Tokens:
    """Tokens of a range of rows: byte starts and ends, hashes, and where each row's tokens begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: np.ndarray):
        """kind: the class of each byte, 0 for bytes between tokens; fold: what each byte counts as."""
        base = int(offsets[0])
        data = data[base: int(offsets[-1])]
        edges = offsets - base
        n = len(data)
        classes = kind[data]
        change = np.empty(n + 1, bool)
        change[:1] = change[n:] = True
        np.not_equal(classes[1:], classes[:-1], out=change[1:n]) if n else None
        change[edges] = True
        cuts = np.flatnonzero(change)
        starts, ends = cuts[:-1], cuts[1:]
        held = classes[starts] > 0 if n else np.zeros(0, bool)
        self.starts, self.ends = starts[held], ends[held]
        running = np.zeros(n + 1, np.uint64)
        np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * _power(_P, n), out=running[1:])
        h = (running[self.ends] - running[self.starts]) * _power(_P_INVERSE, n + 1)[self.starts]
        self.hashes = mix(h ^ (self.ends - self.starts).astype(np.uint64))
        self.kinds = classes[self.starts]
        self.rows = np.searchsorted(self.starts, edges)  # row i has tokens rows[i] .. rows[i + 1]
        self.data, self.base = data, base

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def byte_classes(**classes: str) -> np.ndarray:
    """A class number for each byte, from strings of ASCII characters; `wide` in a name adds all bytes from 0x80 on."""
    table = np.zeros(256, np.uint8)
    for number, (name, characters) in enumerate(classes.items(), 1):
        table[list(characters.encode("ascii"))] = number
        if name.endswith("wide"):
            table[0x80:] = number
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
