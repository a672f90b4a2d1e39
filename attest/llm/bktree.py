"""Forests of BK-trees over 64-bit fingerprints, built and searched level by level in numpy.

A child hangs below its parent at an edge whose number is their Hamming distance. A search at a node of distance d
follows only edges from d - radius to d + radius.
"""
from __future__ import annotations

import numpy as np

FRONTIER = 1 << 20  # (query, node) pairs that are looked at together


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, row by row; wide ones have several numbers in a row."""
    differing = np.bitwise_count(a ^ b)
    return differing.astype(np.int64) if differing.ndim == 1 else differing.sum(axis=1, dtype=np.int64)


class Forest:
    """One tree for each group."""

    def __init__(self, fingerprints: np.ndarray, groups: np.ndarray):
        """fingerprints: uint64 of shape (n,), or (n, lanes) for wide ones; groups: equal values in a row form one tree."""
        self.fingerprints = fingerprints
        n = len(fingerprints)
        self.edges = 64 * (1 if fingerprints.ndim == 1 else fingerprints.shape[1]) + 1
        first = np.append(True, groups[1:] != groups[:-1]) if n else np.zeros(0, bool)
        self.tree = np.cumsum(first) - 1
        self.roots = np.flatnonzero(first)
        keys, children = [], []
        items = np.flatnonzero(~first)
        above = self.roots[self.tree[items]]
        while len(items):
            key = above * self.edges + distances(fingerprints[items], fingerprints[above])
            order = np.argsort(key, kind="stable")
            key, items = key[order], items[order]
            head = np.append(True, key[1:] != key[:-1])
            keys.append(key[head])
            children.append(items[head])
            above = items[head][np.cumsum(head) - 1][~head]
            items = items[~head]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.keys = key[order]  # parent * edges + edge, sorted
        self.children = np.concatenate(children)[order] if keys else np.zeros(0, np.int64)

    def search(self, queries: np.ndarray, trees: np.ndarray, radius: int, frontier: int = FRONTIER):
        """Blocks of (query, node) within the radius, each query asked in its tree."""
        stack = [(np.arange(len(queries)), self.roots[trees])] if len(queries) else []
        while stack:
            query, node = stack.pop()
            if len(query) > frontier:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            distance = distances(queries[query], self.fingerprints[node])
            hit = distance <= radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.keys, node * self.edges + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.keys, node * self.edges + np.minimum(distance + radius, self.edges - 1), side="right")
            n = high - low
            total = int(n.sum())
            if total:
                at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                stack.append((np.repeat(query, n), self.children[at]))

    def within(self, radius: int):
        """Blocks of (query, node) within the radius, each fingerprint asked in its own tree; itself left out."""
        for query, node in self.search(self.fingerprints, self.tree, radius):
            other = query != node
            if other.any():
                yield query[other], node[other]


class Union:
    """Smallest member of each set, as links come in blocks."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            least = np.minimum(x, y)
            np.minimum.at(label, x, least)
            np.minimum.at(label, y, least)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
