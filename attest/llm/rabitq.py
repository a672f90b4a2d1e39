"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector x is turned by random rotations stacked to `bits` coordinates; the code is their signs, read as a vector c
of entries +-1 / sqrt(bits), and the stored factor is f = <c, Rx>. For another unit vector y, <c, Ry> / f is an unbiased
estimate of <x, y>, off by about sqrt((1 - f f) / (f f (bits - 1))) (RaBitQ). Pairs whose estimate plus `sigmas` such
deviations stays below the threshold are let go; all others are recomputed exactly in double precision.

Which pairs are estimated at all is decided by the same codes: cut into bands, two codes meet in the first band in which
they agree. The number of bands is set so that a pair exactly at the threshold meets with probability `recall` at least,
and the width of a band grows with the logarithm of the number of vectors, so that bands of unlike vectors stay small.
A band value that many vectors share is cut into blocks, and the blocks meet in pairs of a bounded size. Links are counted
and united where they are found; pairs never become rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import cells
from .bktree import Union
from .common import materialise, per_row, table
from .graph import components

BLOCK = 256  # vectors of a block that meets another
PAIRS = 1 << 23  # coordinates of pairs looked at together
SIGMAS = 4.0


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a band and number of bands for n vectors."""
    width = min(32, max(8, math.ceil(math.log2(max(n, 2)))) - 2)
    agree = (1 - math.acos(threshold) / math.pi) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def rotation(dimensions: int, bits: int, seed: int = 42) -> np.ndarray:
    """(bits, dimensions): random rotations on top of each other, cut to `bits` rows and scaled to keep lengths."""
    rng = np.random.default_rng(seed)
    turns = []
    for _ in range(-(-bits // dimensions)):
        q, r = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))
        turns.append(q * np.sign(np.diag(r)))
    return np.concatenate(turns)[:bits] * math.sqrt(dimensions / bits)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square is too large or small
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (bool) and correction factors of unit vectors."""
    turned = unit @ turn.T
    return turned > 0, np.abs(turned).sum(axis=1) / math.sqrt(len(turn))


def estimates(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded vectors with turned ones, row by row, and one deviation of each."""
    bits = signs.shape[1]
    product = (2 * np.einsum("ij,ij->i", signs.astype(np.float32), turned) - turned.sum(axis=1)) / math.sqrt(bits)
    return product / factor, np.sqrt(np.maximum(1 - factor * factor, 0) / (factor * factor * (bits - 1)))


def valid(vector: F.Column) -> F.Column:
    """Whether a vector has a direction: it is there, has no null, NaN or infinite part, and is not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(df: DataFrame, threshold: float = 0.95, recall: float = 0.995, sigmas: float = SIGMAS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector (columns vec_id and embedding).

    Vectors without a direction (see `valid`) link with nothing. Vectors of different lengths link with nothing either.
    Equal vectors always link and are compared with others once. Rows of one vec_id are vectors of their own that count
    as others of each other. Rows without an id count as links of others but name no component: theirs is null if no row
    with an id is reachable.
    """
    single = df.schema["embedding"].dataType.elementType.typeName() == "float"
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    rows = df.select("vec_id", doubles.alias("v"))
    classes = materialise(rows.filter(valid(F.col("v"))).groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
                          .withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    counted = None
    for (dimensions,) in sorted(classes.select(F.size("v")).distinct().collect()):  # vectors have one length, or a few
        same = classes.filter(F.size("v") == dimensions)
        more = _linked(same, dimensions, threshold, recall, sigmas, block, np.float32 if single else np.float64)
        counted = more if counted is None else counted.union(more)
    if counted is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    counted = materialise(counted, "vector-links")
    others = counted.filter("other is null").groupBy("node").agg(F.sum("links").alias("others"))
    roots = components(counted.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = materialise(classes.select("node", "v", "least", "copies").join(others, "node", "left").join(roots, "node", "left")
                         .select("v", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                                 F.coalesce("root", "node").alias("root")), "placed-vectors")
    named = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id")), "vector-components")
    known = materialise(placed.join(named, "root").select("v", "n_links", "component_id"), "vector-classes")
    joined = rows.filter(valid(F.col("v"))).join(known, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~valid(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"),
                                      F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _linked(classes: DataFrame, dimensions: int, threshold: float, recall: float, sigmas: float, block: int,
            kind: type) -> DataFrame:
    """Rows (node, links, null): copies of other vectors that a cell found near; and (node, 0, other): links that join sets."""
    spark = classes.sparkSession
    width, bands = plan(classes.count(), threshold, recall)
    turn = spark.sparkContext.broadcast(rotation(dimensions, width * bands).astype(np.float32))
    place = 1 << np.arange(width, dtype=np.int64)

    def coder():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            signs, factor = codes(_unit(v).astype(np.float32), turn.value)
            keys = signs.reshape(-1, bands, width) @ place
            packed = np.packbits(signs, axis=1)
            return pa.RecordBatch.from_arrays([
                batch.column("node"), batch.column("copies"), pa.array([u.tobytes() for u in v.astype(kind)], pa.binary()), pa.array([c.tobytes() for c in packed], pa.binary()),
                pa.array(factor.astype(np.float64)), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "copies", "vector", "code", "factor", "keys"])
        return f

    coded = materialise(per_row(classes.select("node", "copies", "v"), coder,
                                "node long, copies long, vector binary, code binary, factor double, keys array<long>"), "vector-codes")
    dealt = cells.deal(coded.select("node", F.posexplode("keys").alias("band", "key")), block)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in cells.whole(batches):
            yield _meeting(rows, turn.value, width, threshold, sigmas, kind)

    gathered = cells.gathered(dealt, coded.select("node", "copies", "vector", "code", "factor"))
    return gathered.mapInArrow(meet, "node long, links long, other long")


def _meeting(rows: pa.Table, turn: np.ndarray, width: int, threshold: float, sigmas: float, kind: type) -> pa.RecordBatch:
    """What the cells in these rows find; rows of a cell stand together."""
    band, i, j = (rows[c].to_numpy() for c in ("band", "i", "j"))
    left, node, copies = (rows[c].to_numpy(zero_copy_only=False) for c in ("left", "node", "copies"))
    n = len(node)
    unit = _unit(np.frombuffer(b"".join(rows["vector"].to_pylist()), kind).reshape(n, -1).astype(np.float64))
    signs = np.unpackbits(np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(n, -1), axis=1)[:, : len(turn)]
    keys = signs.reshape(n, -1, width) @ (1 << np.arange(width, dtype=np.int64))
    factor = rows["factor"].to_numpy()
    turned = unit.astype(np.float32) @ turn.T
    change = cells.starts(rows)
    links, sets = np.zeros(n, np.int64), Union(n)
    most = max(1024, PAIRS // len(turn))
    for a, b in _pairs(change, np.append(change[1:], n), left, i == j, most):
        for at in range(0, len(a), most):
            x, y = a[at: at + most], b[at: at + most]
            # Met before, in an earlier band?
            first = (keys[x] == keys[y]).argmax(axis=1) == band[x]
            x, y = x[first], y[first]
            value, deviation = estimates(signs[x], factor[x], turned[y])
            open_ = value + sigmas * deviation >= threshold
            x, y = x[open_], y[open_]
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[near], y[near]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            sets.link(x, y)
    some = np.flatnonzero(links)
    joined = np.flatnonzero(sets.label != np.arange(n))
    none = pa.nulls(len(some), pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([node[some], node[joined]])), pa.array(np.concatenate([links[some], np.zeros(len(joined), np.int64)])),
        pa.concat_arrays([none, pa.array(node[sets.label[joined]], pa.int64())])], ["node", "links", "other"])


def _pairs(starts: np.ndarray, ends: np.ndarray, left: np.ndarray, own: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that meet, in blocks: all of a cell of one block, else those of its left with those of its right block."""
    a, b, size = [], [], 0
    for start, end in zip(starts.tolist(), ends.tolist()):
        if own[start]:
            x, y = np.triu_indices(end - start, 1)
        else:
            here, there = np.flatnonzero(left[start:end]), np.flatnonzero(~left[start:end])
            x, y = np.repeat(here, len(there)), np.tile(there, len(here))
        a.append(x + start)
        b.append(y + start)
        size += len(x)
        if size >= most:
            yield np.concatenate(a), np.concatenate(b)
            a, b, size = [], [], 0
    if size:
        yield np.concatenate(a), np.concatenate(b)


def op10_vectors(spark: SparkSession, d: str) -> DataFrame:
    return near_vectors(table(spark, d, "embeddings").select("vec_id", "embedding"))
