"""Exact and cell-based nearest vectors for whole batches of queries (E-05, T-06 .. T-08).

Scoring a batch of queries against all vectors is done one Arrow batch at a time
as a matrix product that keeps only the best k per query, so pairs never become
rows. Two layouts share that kernel:

* a query batch whose size is checked to be small is shipped to every task and
  the vectors are read where they lie, without a shuffle;
* larger query batches are cut into blocks and vectors into tiles, and each
  (block, tile) meets in a group of bounded size.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import vectors as V
from .topk import require_positive, top_k

BROADCAST_BYTES = 64 << 20
TILE_BYTES = 32 << 20
KERNEL_BYTES = 32 << 20  # similarities that are held at once
# Similarities are ranked at ten decimals, so equal vectors tie and the id decides.
DECIMALS = 10


def vector_violations(vectors: DataFrame, id_col: str = "chunk_id", dimension: int = 768, tolerance: float = 1e-6) -> DataFrame:
    """E-05: vectors of the wrong dimension or length."""
    v = F.col("embedding")
    found = F.array_compact(F.array(
        F.when(v.isNull() | (F.size(v) != dimension), "dimension"),
        F.when(~F.coalesce(V.is_unit(v, tolerance), F.lit(False)), "norm")))
    return vectors.select(id_col, found.alias("violations")).where(F.size("violations") > 0)


def has_direction(v: Column) -> Column:
    """A vector that can be compared: not null, without null, NaN and infinite parts, and not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def vector_rejects(vectors: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Vectors that no search compares, and why."""
    reason = F.when(F.col("embedding").isNull(), "no vector").otherwise("no direction")
    return vectors.where(~has_direction(F.col("embedding"))).select(id_col, reason.alias("reason"))


def _matrix(values, dim: int) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in values]) if len(values) else np.zeros((0, dim))
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The first k per query by score descending, id ascending."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = place < k
    return query[keep], ids[keep], score[keep]


def _score(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """Best k of one batch for each query, in blocks of queries and rows whose similarities fit KERNEL_BYTES."""
    rows = max(k, min(len(ids), 8192))
    step = max(1, KERNEL_BYTES // (8 * max(1, rows)))
    found = []
    for at in range(0, len(queries), step):
        own = None
        for first in range(0, len(ids), rows):
            q, c, s = _score_block(queries[at: at + step], vectors[first: first + rows], ids[first: first + rows], k)
            own = (q + at, c, s) if own is None else _best(*(np.concatenate(p) for p in zip(own, (q + at, c, s))), k)
        if own is not None:
            found.append(own)
    if not found:
        return np.zeros(0, np.int64), ids[:0], np.zeros(0)
    return tuple(np.concatenate(p) for p in zip(*found))


def _score_block(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """Candidates of one block: everything not below the k-th best of its query."""
    s = np.round(queries @ vectors.T, DECIMALS)
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        q, c = np.nonzero(s >= kth[:, None])
    else:
        q, c = np.nonzero(np.ones_like(s, dtype=bool))
    return _best(q, ids[c], s[q, c], k)


def _id_array(ids: pd.Series) -> np.ndarray:
    a = ids.to_numpy()
    return a.astype(str) if a.dtype == object else a


def _searcher(qids, qmatrix, k: int, dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = qids.value, qmatrix.value
        state = None
        for batch in batches:
            if batch.empty:
                continue
            ids = _id_array(batch["chunk_id"])
            found = _score(matrix, _matrix(batch["embedding"].to_numpy(), dim), ids, k)
            if state is not None:
                found = _best(*(np.concatenate(p) for p in zip(state, found)), k)
            state = found
        if state is not None and len(state[0]):
            yield pd.DataFrame({"query_id": names[state[0]], "chunk_id": state[1], "similarity": state[2]})

    return run


def _tile_search(k: int):
    """Kernel of one (block, tile) group; both sides are bounded by the layout."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "similarity": []})
        q, ids, s = _score(
            _matrix(right["query_vector"].to_numpy(), 0), _matrix(left["embedding"].to_numpy(), 0),
            _id_array(left["chunk_id"]), k)
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[q], "chunk_id": ids, "similarity": s})

    return run


def _types(queries: DataFrame, vectors: DataFrame) -> str:
    q, c = queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    return f"query_id {q}, chunk_id {c}, similarity double"


def _rank(found: DataFrame, k: int, rank: str) -> DataFrame:
    return top_k(found, ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], k, rank)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = C.CANDIDATES, where: Column | None = None,
                rank: str = "vector_rank", broadcast_bytes: int = BROADCAST_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """T-06, T-07: exact best k by cosine similarity, ties by chunk id.

    ``queries``: query_id, embedding. ``vectors``: chunk_id, embedding, and any
    columns ``where`` needs; the filter reaches the scan. Vectors without a direction
    are in no ranking, on either side: ``vector_rejects`` names them.
    """
    require_positive(k=k)
    kept = vectors.where(where) if where is not None else vectors
    kept = kept.where(has_direction(F.col("embedding"))).select("chunk_id", "embedding")
    asked = queries.where(has_direction(F.col("embedding"))).select("query_id", "embedding")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    n, dim = size["n"], size["d"] or 0
    types = _types(asked, kept)
    if n * dim * 8 <= broadcast_bytes:
        rows = asked.limit(n).toPandas() if n else pd.DataFrame({"query_id": [], "embedding": []})
        sc = queries.sparkSession.sparkContext
        ids = sc.broadcast(rows["query_id"].to_numpy())
        matrix = sc.broadcast(_matrix(rows["embedding"].to_numpy(), dim))
        return _rank(kept.mapInPandas(_searcher(ids, matrix, k, dim), types), k, rank)

    per_tile = max(k, tile_bytes // max(1, dim * 8))
    blocks = -(-n // max(1, broadcast_bytes // max(1, dim * 8)))
    tiles = max(1, -(-kept.count() // per_tile))
    asked = asked.select("query_id", F.col("embedding").alias("query_vector"))
    left = kept.withColumn("tile", F.pmod(F.xxhash64("chunk_id"), F.lit(tiles)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    found = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInPandas(_tile_search(k), types)
    return _rank(found, k, rank)


# --- cells ------------------------------------------------------------------------------------


def fit_cells(vectors: DataFrame, lists: int = 100, seed: int = 42, max_iter: int = 10):
    """Cell centres by spherical k-means; the model holds ``lists`` vectors and nothing else."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = vectors.select(array_to_vector(V.l2_normalise(F.col("embedding"))).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(features)
    return [[float(x) for x in centre] for centre in model.clusterCenters()]


def with_cells(df: DataFrame, centres: list[list[float]], n: int = 1) -> DataFrame:
    """One row per nearest cell of each vector."""
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(_matrix(np.array(centres), len(centres[0])))

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            s = np.round(_matrix(v.to_numpy(), shared.value.shape[1]) @ shared.value.T, DECIMALS)
            yield pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :n].astype("int32")), index=v.index)

    return df.withColumn("cell", F.explode(nearest("embedding")))


def ivf_topk(queries: DataFrame, vectors: DataFrame, k: int = C.CANDIDATES, lists: int = 100, n_probe: int = 1,
             centres: list[list[float]] | None = None, tile_bytes: int = TILE_BYTES, rank: str = "vector_rank") -> DataFrame:
    """T-08: best k within the ``n_probe`` cells nearest to each query. Full cells are cut into tiles."""
    require_positive(k=k, lists=lists, n_probe=n_probe)
    kept = vectors.where(has_direction(F.col("embedding"))).select("chunk_id", "embedding")
    asked = queries.where(has_direction(F.col("embedding"))).select("query_id", "embedding")
    centres = centres or fit_cells(kept, lists)
    placed, probes = with_cells(kept, centres), with_cells(asked, centres, n_probe)
    per_tile = max(k, tile_bytes // (len(centres[0]) * 8))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(per_tile)).cast("int").alias("tiles"))
    many = probes.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(per_tile)).cast("int").alias("blocks"))
    layout = sizes.join(many, "cell")
    probes = probes.select("query_id", F.col("embedding").alias("query_vector"), F.col("cell").alias("cell"))
    tile = F.pmod(F.xxhash64("chunk_id"), F.col("tiles")).cast("int")
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
    left = placed.join(layout, "cell").withColumn("tile", tile).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("tiles", "blocks")
    right = probes.join(layout, "cell").withColumn("block", block).withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles", "blocks")
    keys = ["cell", "block", "tile"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_tile_search(k), _types(asked, kept))
    return _rank(found, k, rank)
