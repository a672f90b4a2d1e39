"""A stored vector index by cells (T-08): fitted once, searched by reading, extended without fitting again.

A folder holds the cell centres, a table of placed vectors partitioned by cell, and a directory of each vector's cell. A
placed vector has an eight-bit code of what its unit vector differs from its centre (the residual) with its scale, and the
length of what the code leaves out. A search reads the codes of the cells nearest to each query only. Scores from codes are
off by no more than that length, so the vectors that can be among the best k are known, and only these are read in full.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as V
from ..operators.topk import require_positive, top_k
from ..operators.vector_search import DECIMALS, TILE_BYTES, _id_array, _matrix, fit_cells, has_direction, with_cells
from ..session import materialise

SAMPLE = 1_000_000  # vectors that centres are fitted on, at most; all are placed
SLACK = 1e-6  # rounding of scores from single precision


def _coded(unit: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and the lengths of what they leave out."""
    rest = unit - centre
    scale = np.abs(rest).max(axis=1) / 127
    codes = np.rint(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).astype(np.int8)
    return codes, scale, np.linalg.norm(rest - codes * scale[:, None], axis=1)


class VectorIndex:
    """An index in a folder; see the module. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def create(spark: SparkSession, path: str, vectors: DataFrame | None = None, lists: int = 100, centres: list[list[float]] | None = None) -> VectorIndex:
        """Fit `lists` centres on a bounded sample of vectors (chunk_id, embedding), or take given ones, and store them. Nothing is placed yet."""
        if centres is None:
            require_positive(lists=lists)
            kept = vectors.where(has_direction(F.col("embedding")))
            n = kept.count()
            if n > SAMPLE:
                kept = kept.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30)))
            centres = fit_cells(kept, lists)
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return VectorIndex(spark, path)

    def centres(self) -> list[list[float]]:
        return [r["centre"] for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()]  # as many as there are cells

    def placed(self) -> DataFrame:
        """chunk_id, embedding, code, scale, left_out and cell of every vector."""
        return self.spark.read.parquet(f"{self.path}/placed")

    def _exists(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/placed/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def add(self, vectors: DataFrame) -> None:
        """Place vectors (chunk_id, embedding), each id once; ids that are there already are replaced. Vectors without a direction
        are left out (`vector_rejects` names them). Only cells that lose or gain a vector are rewritten; a failed call is mended by
        the same call again."""
        centres = _matrix(np.array(self.centres()), 0)
        rows = vectors.where(has_direction(F.col("embedding"))).select("chunk_id", "embedding")
        rows = with_cells(rows, [list(c) for c in centres])
        shared = self.spark.sparkContext.broadcast(centres)

        @F.pandas_udf("struct<code: binary, scale: double, left_out: double>")
        def code(embedding: pd.Series, cell: pd.Series) -> pd.DataFrame:
            codes, scale, left_out = _coded(_matrix(embedding.to_numpy(), shared.value.shape[1]), shared.value[cell.to_numpy()])
            return pd.DataFrame({"code": [c.tobytes() for c in codes], "scale": scale, "left_out": left_out})

        new = rows.withColumn("c", code("embedding", "cell")).select("chunk_id", "embedding", "c.code", "c.scale", "c.left_out", "cell")
        new = materialise(new, "placed-vectors")
        if not self._exists():
            new.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/placed")
            return
        base = self.placed()
        lost = base.select("chunk_id", "cell").join(new.select("chunk_id"), "chunk_id", "left_semi").select("cell")
        touched = [r[0] for r in lost.union(new.select("cell")).distinct().collect()]  # at most as many as there are cells
        kept = base.where(F.col("cell").isin(touched)).join(new.select("chunk_id"), "chunk_id", "left_anti")
        fresh = materialise(kept.select(new.columns).union(new), "touched-cells")
        fresh.repartition("cell").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{self.path}/placed")
        # A cell that has lost all its vectors is not rewritten: its rows are those of replaced ids.
        emptied = sorted(set(touched) - {r[0] for r in fresh.select("cell").distinct().collect()})
        for cell in emptied:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/placed/cell={cell}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def search(self, queries: DataFrame, k: int, n_probe: int = 1, tile_bytes: int = TILE_BYTES, rank: str = "vector_rank") -> DataFrame:
        """query_id, chunk_id, similarity and rank: the exact best k within the `n_probe` cells nearest to each query (query_id, embedding)."""
        require_positive(k=k, n_probe=n_probe)
        centres = self.centres()
        asked = queries.where(has_direction(F.col("embedding"))).select("query_id", "embedding")
        probes = materialise(with_cells(asked, centres, n_probe), "probes")
        cells = [r[0] for r in probes.select("cell").distinct().collect()]  # at most as many as there are cells
        coded = self.placed().where(F.col("cell").isin(cells) if cells else F.lit(False)).select("chunk_id", "code", "scale", "left_out", "cell")
        per_tile = max(k, tile_bytes // max(1, len(centres[0]) * 8))
        sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(per_tile)).cast("int").alias("tiles"))
        many = probes.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(per_tile)).cast("int").alias("blocks"))
        layout = sizes.join(many, "cell")  # a row for each cell
        tile, block = F.pmod(F.xxhash64("chunk_id"), F.col("tiles")).cast("int"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
        left = coded.join(layout, "cell").withColumn("tile", tile).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = probes.join(layout, "cell").withColumn("block", block).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        keys = ["cell", "block", "tile"]
        left, right = left.drop("tiles", "blocks"), right.drop("tiles", "blocks")
        q, c = queries.schema["query_id"].dataType.simpleString(), coded.schema["chunk_id"].dataType.simpleString()
        shared = self.spark.sparkContext.broadcast(_matrix(np.array(centres), 0))

        def bounds(vectors: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            if vectors.empty or some.empty:
                return pd.DataFrame({"query_id": [], "chunk_id": [], "low": [], "high": []})
            centre = shared.value[int(vectors["cell"].iloc[0])]
            matrix = _matrix(some["embedding"].to_numpy(), 0)
            codes = np.frombuffer(b"".join(vectors["code"]), np.int8).reshape(len(vectors), -1).astype(np.float64) * vectors["scale"].to_numpy()[:, None]
            ids, off = _id_array(vectors["chunk_id"]), vectors["left_out"].to_numpy() + SLACK
            out = []
            for at in range(0, len(matrix), 256):
                part = matrix[at: at + 256]
                about = part @ codes.T + (part @ centre)[:, None]
                low = about - off
                least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(part), -np.inf)
                i, j = np.nonzero(about + off >= least[:, None])
                out.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[at + i], "chunk_id": ids[j], "low": low[i, j], "high": about[i, j] + off[j]}))
            return pd.concat(out)

        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(bounds, f"query_id {q}, chunk_id {c}, low double, high double")
        found = materialise(found, "bounded-vectors")
        kth = top_k(found, ["query_id"], [F.desc("low"), F.asc("chunk_id")], k, "__n").where(F.col("__n") == k).select("query_id", F.col("low").alias("least"))
        open_ = found.join(kth, "query_id", "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("query_id", "chunk_id")
        full = self.placed().where(F.col("cell").isin(cells) if cells else F.lit(False)).select("chunk_id", F.col("embedding").alias("v"))
        rows = open_.join(full, "chunk_id").join(asked.withColumnRenamed("embedding", "q"), "query_id")
        scored = rows.select("query_id", "chunk_id", F.round(V.cosine_similarity(F.col("q"), F.col("v")), DECIMALS).alias("similarity"))
        return top_k(scored, ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], k, rank)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """recall: the share of the exact rows (query_id, chunk_id) that are found, averaged over queries."""
    total = exact.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = exact.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return total.join(hits, "query_id", "left").agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))
