"""SimHash near-duplicates: fingerprints of word shingles, searched with BK-trees, and joined into components.

Trees are sharded by what two near fingerprints must share: with the 64 bits cut into radius + 2 blocks, two fingerprints
within the radius agree on at least two blocks. Each pair of blocks makes one shard of a fingerprint, named by the values
of the two blocks; a tree holds the fingerprints of a shard and answers for them. A shard with more fingerprints than
`CAP` is cut again by the bits that it does not yet share, until shards are small. So trees are sent to the tasks that
ask them rather than broadcast to all: all trees together grow with the input.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.fetch import bloom, maybe
from . import cells, flat
from .bktree import Forest, Union, distances
from .common import materialise, per_row, released, table
from .graph import components

CAP = 512  # fingerprints of a shard that is not cut again
FLUSH = 100_000  # fingerprints that a task holds at once
FRONTIER = 1 << 18  # wide fingerprints that are compared at once


def fingerprint(text: str | bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is set in over half of the shingles' XXH64.

    A-Z are lower-cased, words stand between ASCII white space, a text of fewer words is one shingle, and a text without
    words has fingerprint zero.
    """
    split = (text.encode() if isinstance(text, str) else text).lower().split()
    if not split:
        return 0
    total, n = np.zeros(64, np.int64), max(1, len(split) - words + 1)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 50_000):
        some = split[at: at + 50_000 + words - 1]
        shingles = zip(*(some[i:] for i in range(words))) if len(split) >= words else [some]
        h = np.array([digest(b" ".join(s), seed) for s in shingles], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n).view(">u8")[0])


def fingerprints(df: DataFrame, keep: str = "doc_id long", text_col: str = "text", words: int = 3) -> DataFrame:
    """The kept columns and `fingerprint` (long, the 64 bits as a signed number) of every row; a null text is empty."""
    names = [c.strip().split(" ")[0] for c in keep.split(",")]

    def hasher():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            column, out = batch.column("__text"), []
            for at in range(0, batch.num_rows, 64):
                out += [fingerprint(t or "", words) for t in column.slice(at, 64).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(np.array(out, np.uint64).view(np.int64))], [*names, "fingerprint"])
        return f

    return per_row(df.select(*names, F.col(text_col).alias("__text")), hasher, f"{keep}, fingerprint long")


def _masks(radius: int, free: int = (1 << 64) - 1) -> list[int]:
    """Masks such that fingerprints within the radius, equal outside `free`, agree on all bits of at least one of them."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    blocks = [sum(bits[i * len(bits) // (radius + 2): (i + 1) * len(bits) // (radius + 2)]) for i in range(radius + 2)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, radius: int = 2, cap: int = CAP) -> DataFrame:
    """Links a, b between distinct fingerprints (column fingerprint) that join all that are within the radius.

    Not every pair within the radius is given: in each shard linked fingerprints are all linked to their least one.
    """
    def split(masks: list[tuple[int, int]]) -> F.Column:
        # A shard's name: which mask, and the bits under it.
        return F.explode(F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("shard"))
                                   for m in masks)))

    rows = prints.select("fingerprint", split(_masks(radius)).alias("s")).select("fingerprint", "s.mask", "s.shard")
    found = None
    while True:
        sizes = rows.groupBy("mask", "shard").count()
        large = materialise(sizes.filter(F.col("count") > cap), "large-shards")
        masks = [r[0] for r in large.select("mask").distinct().collect()]  # some tens at most
        if not masks:
            more = _searched(rows, radius)
            return more if found is None else found.union(more)
        small = rows.join(large.select("mask", "shard"), ["mask", "shard"], "left_anti")
        more = _searched(small, radius)
        found = more if found is None else found.union(more)
        rest = rows.join(large.select("mask", "shard"), ["mask", "shard"], "left_semi")
        cut, stuck = None, []
        for m in masks:
            whole = m & ((1 << 64) - 1)
            free = ((1 << 64) - 1) ^ whole
            if bin(free).count("1") < radius + 2:
                stuck.append(m)  # cannot happen with a cap over 2 ** (radius + 1): such a shard has no more values
                continue
            deeper = [whole | x for x in _masks(radius, free)]
            part = rest.filter(F.col("mask") == m).select("fingerprint", split(deeper).alias("s")).select("fingerprint", "s.mask", "s.shard")
            cut = part if cut is None else cut.union(part)
        if stuck:
            found = found.union(_searched(rest.filter(F.col("mask").isin(stuck)), radius))
        if cut is None:
            return found
        rows = materialise(cut.distinct(), "cut-shards")


def _searched(rows: DataFrame, radius: int) -> DataFrame:
    """Links inside each shard, found with its BK-tree; a task holds about FLUSH fingerprints at once."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def linked(columns: list[np.ndarray]) -> pa.RecordBatch:
            mask, shard, prints = columns
            change = np.append(True, (mask[1:] != mask[:-1]) | (shard[1:] != shard[:-1]))
            forest, sets = Forest(prints.view(np.uint64), np.cumsum(change)), Union(len(prints))
            for query, node in forest.within(radius):
                sets.link(query, node)
            other = np.flatnonzero(sets.label != np.arange(len(prints)))
            return pa.RecordBatch.from_arrays([pa.array(prints[other]), pa.array(prints[sets.label[other]])], ["a", "b"])

        for batch in batches:
            held.append([batch.column(n).to_numpy(zero_copy_only=False) for n in ("mask", "shard", "fingerprint")])
            size += batch.num_rows
            if size >= FLUSH:
                columns = [np.concatenate(c) for c in zip(*held)]
                last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last shard may go on
                if cut:
                    yield linked([c[:cut] for c in columns])
                held = [[c[cut:] for c in columns]]
                size = len(held[0][0])
        if size:
            yield linked([np.concatenate(c) for c in zip(*held)])

    dealt = rows.repartition("mask", "shard").sortWithinPartitions("mask", "shard", "fingerprint")
    return dealt.select("mask", "shard", "fingerprint").mapInArrow(search, "a long, b long")


def near_duplicates(df: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (long) and component_id, the smallest doc_id reachable by links, of every row.

    Fingerprints of `radius` or fewer differing bits link. Rows without an id have a component if a row with an id is
    reachable, else a null; repeated rows are rows of one document. Null and empty texts have fingerprint zero and link
    like any other.
    """
    rows = materialise(fingerprints(df, words=words), "fingerprints")
    prints = materialise(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(materialise(links(prints, radius), "simhash-links"))
    rooted = materialise(
        prints.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        .select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(rooted.join(materialise(named, "components"), "root").select("fingerprint", "component_id"), "classes")
    return rows.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


# --- near copies of a given similarity ---------------------------------------------------------


LANES = 4  # 64-bit numbers of a wide fingerprint


def shingle_hashes(text: str | bytes, words: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; a text of fewer words is one shingle, one without words has none."""
    split = (text.encode() if isinstance(text, str) else text).lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    shingles = zip(*(split[i:] for i in range(words))) if len(split) >= words else [split]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(s)) for s in shingles), np.uint64))


def wide_fingerprint(text: str | bytes, words: int = 5, lanes: int = LANES) -> bytes:
    """A SimHash of 64 * lanes bits over the distinct shingles: lane i takes their hashes, mixed with i."""
    return _wide(shingle_hashes(text, words), lanes)


def _wide(hashes: np.ndarray, lanes: int = LANES) -> bytes:
    total = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 20_000):
        h = hashes[at: at + 20_000]
        for i in range(lanes):
            own = flat.mix(h + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.uint8).reshape(-1, 8)
            total[64 * i: 64 * i + 64] += np.unpackbits(own, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).tobytes()


def search_plan(n: int, similarity: float, recall: float, lanes: int = LANES) -> tuple[int, int, int]:
    """Radius, bits of a band, and number of bands, for n fingerprints.

    Two texts whose shingles have Jaccard similarity s have a cosine of 2 s / (1 + s), and a bit differs with probability
    acos(cosine) / pi. The radius is the expected number of differing bits at the similarity, and three deviations more. A
    pair at the similarity shares some band with probability `recall`; bands of about 64 unlike texts each.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * lanes
    width = max(8, math.ceil(math.log2(max(n, 2))) - 6)
    return int(bits * p + 3 * math.sqrt(bits * p * (1 - p))), width, math.ceil(math.log(1 - recall) / math.log(1 - (1 - p) ** width))


JOINED = 200_000  # texts of which the first round knows in a task what is joined already
SETS = 1 << 20  # shingles of texts that a task keeps for the next pairs
_TEXT = ("t1", "t2")  # two hashes of a text, which name it


def _named_texts(df: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def _nearest(query: np.ndarray, node: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs in order of the query and the distance, and each pair's rank in its query."""
    order = np.lexsort((node, distance, query))
    query, node = query[order], node[order]
    head = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    return query, node, np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))


def _forest(x: np.ndarray, y: np.ndarray, up: dict[int, int]) -> np.ndarray:
    """Which pairs join two sets of `up`, one after the other."""
    def root(n: int) -> int:
        while (above := up.setdefault(n, n)) != n:
            up[n] = n = up[above]
        return n

    if len(up) > JOINED:
        up.clear()
    out = np.zeros(len(x), bool)
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        a, b = root(a), root(b)
        if a != b:
            up[a], out[k] = b, True
    return out


def _alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs a, b whose texts' distinct shingles have at least the Jaccard similarity."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a") \
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def compare():
        kept: dict[int, np.ndarray] = {}
        size = 0

        def hashes(node: int, text: pa.Scalar) -> np.ndarray:
            nonlocal size
            if node not in kept:
                if size > SETS:
                    kept.clear()
                    size = 0
                kept[node] = shingle_hashes(text.as_py(), words)
                size += len(kept[node])
            return kept[node]

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            held = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                x, y = hashes(a, batch.column("text_a")[i]), hashes(b, batch.column("text_b")[i])
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and common / (len(x) + len(y) - common) >= similarity:
                    held.append(i)
            rows = pa.array(held, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], ["a", "b"])
        return f

    return per_row(both.select("a", "b", "text_a", "text_b"), compare, "a long, b long")


def similar_texts(df: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.99, block: int = 512) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable by links, of every row.

    Links are pairs of texts whose distinct shingles have at least the Jaccard similarity, compared exactly. Candidates
    are pairs whose wide fingerprints share a band of bits and are within the radius of `search_plan`; they meet in cells
    of bounded size, where one side's BK-tree answers the other. A tree over the texts' nearest candidates is compared first, so a
    large group of copies needs few pairs. Cells that hold several components by then are searched again on fingerprints alone; texts
    that still have a pair to compare get their shingles there, for the first band only that a pair shares. Rows without words
    are copies of each other. Ids as in `near_duplicates`.
    """

    def hasher():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            column, out, same, sizes = batch.column("text"), [], [], []
            for at in range(0, batch.num_rows, 64):
                for t in column.slice(at, 64).to_pylist():
                    h = shingle_hashes(t, words)
                    out.append(_wide(h))
                    same.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sizes.append(len(h))
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", *_TEXT)), pa.array(out, pa.binary()), pa.array(same, pa.binary()), pa.array(sizes, pa.int32())],
                                              ["doc_id", *_TEXT, "print", "same", "size"])
        return f

    rows = materialise(per_row(_named_texts(df), hasher, "doc_id long, t1 long, t2 long, print binary, same binary, size int"), "wide-fingerprints")
    # A node is a set of shingles; one of its texts stands for it.
    prints = materialise(rows.groupBy("same").agg(F.min("doc_id").alias("least"), F.first("print").alias("print"), F.first("size").alias("size"),
                                                  F.min(F.struct(*_TEXT)).alias("t")).withColumn("node", F.monotonically_increasing_id()), "wide-prints")
    radius, width, bands = search_plan(prints.count(), similarity, recall)
    rng = np.random.default_rng(42)
    chosen = np.stack([rng.permutation(64 * LANES)[:width] for _ in range(bands)])
    place = 1 << np.arange(width, dtype=np.int64)

    def keys():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
            return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(bits[:, chosen] @ place), pa.list_(pa.int64()))], ["node", "keys"])
        return f

    banded = materialise(per_row(prints.select("node", "print"), keys, "node long, keys array<long>").select("node", F.posexplode("keys").alias("band", "key")), "bands")
    dealt = cells.deal(banded, block)

    def candidates(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the pairs within the radius, and which is the nearest of its query."""
        fingerprint = np.frombuffer(b"".join(rows["print"].to_pylist()), ">u8").reshape(rows.num_rows, -1).astype(np.uint64)
        start = cells.starts(rows)
        cell = np.repeat(np.arange(len(start)), np.diff(np.append(start, rows.num_rows)))
        left, own = rows["left"].to_numpy(), (rows["i"].to_numpy() == rows["j"].to_numpy())
        nodes, size = np.flatnonzero(left), rows["size"].to_numpy()
        forest = Forest(fingerprint[nodes], cell[nodes])
        tree_of = np.full(len(start), -1)
        tree_of[cell[nodes[forest.roots]]] = np.arange(len(forest.roots))
        asked = np.flatnonzero((own | ~left) & (tree_of[cell] >= 0))
        found = [np.zeros((2, 0), np.int64)]
        for query, hit in forest.search(fingerprint[asked], tree_of[cell[asked]], radius, FRONTIER):
            query, hit = asked[query], nodes[hit]
            # Sets of so unlike sizes cannot reach the similarity.
            ok = (query != hit) & (np.minimum(size[query], size[hit]) >= similarity * np.maximum(size[query], size[hit]) - 1e-6)
            found.append(np.stack([query[ok], hit[ok]]))
        query, hit = np.concatenate(found, axis=1)
        query, hit, rank = _nearest(query, hit, distances(fingerprint[query], fingerprint[hit]))
        return query, hit, rank == 0

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        for rows in cells.whole(batches):
            query, hit, ok = candidates(rows)
            node = rows["node"].to_numpy()
            ok[ok] = _forest(node[query[ok]], node[hit[ok]], up)
            x, y, more = node[query[ok]], node[hit[ok]], np.unique(np.append(query[~ok], hit[~ok]))
            # Pairs to compare, and the rows of all others for the next round.
            rest = [pa.array(np.append(np.zeros(len(x), t), rows[k].to_numpy()[more].astype(t)))
                    for k, t in zip((*cells.KEYS, "left"), (np.int32, np.int64, np.int32, np.int32, bool))]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.minimum(x, y), node[more])), pa.array(np.append(np.maximum(x, y), node[more])),
                                              pa.array(np.append(np.zeros(len(x), bool), np.ones(len(more), bool))), *rest], ["a", "b", "more", *cells.KEYS, "left"])

    def open_pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the pairs within the radius whose texts are not in one component, each in the first band that they share."""
        query, hit, _ = candidates(rows)
        root = rows["root"].to_numpy()
        ok = (root[query] != root[hit]) & ((query > hit) | ~rows["left"].to_numpy()[query])
        query, hit = query[ok], hit[ok]
        bits = np.unpackbits(np.frombuffer(b"".join(rows["print"].to_pylist()), np.uint8).reshape(rows.num_rows, -1), axis=1)
        first = np.zeros(len(query), np.int64)
        step = max(1, (16 << 20) // chosen.size)
        for at in range(0, len(query), step):
            own = slice(at, at + step)
            first[own] = (bits[query[own]][:, chosen] == bits[hit[own]][:, chosen]).all(axis=2).argmax(axis=1)
        ok = first == rows["band"].to_numpy()[query]
        return query[ok], hit[ok]

    def still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in cells.whole(batches):
            some = pa.array(np.unique(np.concatenate(open_pairs(rows))))
            yield rows.select(["node", *cells.KEYS, "left"]).take(some).combine_chunks().to_batches()[0] if len(some) else \
                pa.RecordBatch.from_pylist([], rows.select(["node", *cells.KEYS, "left"]).schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in cells.whole(batches, 512):
            query, hit = open_pairs(rows)
            node, size, kept = rows["node"].to_numpy(), rows["size"].to_numpy(), {}
            up: dict[int, int] = {}
            a, b = [], []

            def shingles(k: int, rows=rows, kept=kept) -> frozenset:
                if k not in kept:
                    kept[k] = frozenset(np.frombuffer(rows["shingles"][k].as_py(), np.uint64).tolist())
                return kept[k]

            for x, y in zip(query.tolist(), hit.tolist()):
                common = len(shingles(x) & shingles(y))
                if common and common / (int(size[x]) + int(size[y]) - common) >= similarity:
                    a.append(int(node[x]))
                    b.append(int(node[y]))
            joins = _forest(np.array(a, np.int64), np.array(b, np.int64), up)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[joins]), pa.array(np.array(b, np.int64)[joins])], ["a", "b"])

    def hashed():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_hashes(t.as_py(), words).tobytes() for t in batch.column("text")], pa.binary())], ["node", "shingles"])
        return f

    named = _named_texts(df).drop("doc_id")

    def texts(nodes: DataFrame, name: str) -> DataFrame:
        wanted = materialise(prints.join(nodes.distinct(), "node").select("node", "t.*"), f"{name}-wanted")
        # What is surely not wanted is dropped where it lies: only texts of candidates are shuffled.
        some = maybe(named, _TEXT[0], bloom(wanted, _TEXT[0], wanted.count()))
        return some.join(wanted, list(_TEXT)).groupBy("node").agg(F.first("text").alias("text"))

    found = materialise(cells.gathered(dealt, prints.select("node", "print", "size"))
                        .mapInArrow(meet, "a long, b long, more boolean, band int, key long, i int, j int, left boolean"), "similar-met")
    released(banded)
    released(dealt)
    pairs = materialise(found.filter("not more").select("a", "b").distinct(), "similar-pairs")
    held = materialise(texts(pairs.select(F.explode(F.array("a", "b")).alias("node")), "similar-texts"), "similar-texts")
    links = materialise(_alike(pairs, held, words, similarity), "similar-links")
    released(held)
    roots = components(links)
    # What the first round left: cells of unlike components, and of them the texts that still have a pair to compare.
    rest = found.filter("more").select(F.col("a").alias("node"), *cells.KEYS, "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = materialise(rest, "similar-rest")
    released(found)
    mixed = rest.groupBy(*cells.KEYS).agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select(*cells.KEYS)
    still = materialise(cells.gathered(rest.join(mixed, list(cells.KEYS), "left_semi"), prints.select("node", "print", "size"))
                        .mapInArrow(still_open, "node long, band int, key long, i int, j int, left boolean"), "similar-open")
    released(rest)
    if not still.isEmpty():
        # Sets of shingles go to these only.
        sets = materialise(per_row(texts(still.select("node"), "similar-sets"), hashed, "node long, shingles binary"), "similar-sets")
        payload = prints.select("node", "print", "size").join(sets, "node").join(roots, "node", "left") \
            .select("node", "print", "size", "shingles", F.coalesce("root", "node").alias("root"))
        more = materialise(cells.gathered(still, payload).mapInArrow(compare, "a long, b long"), "similar-more-links")
        released(sets)
        roots = components(links.union(more))
    rooted = materialise(prints.join(roots, "node", "left").select("same", "least", F.coalesce("root", "node").alias("root")), "similar-rooted")
    named = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "similar-components")
    classes = materialise(rooted.join(named, "root").select("same", "component_id"), "similar-classes")
    return rows.join(classes, "same").select("doc_id", "component_id")


def op9_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = near_duplicates(table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
