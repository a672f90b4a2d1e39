"""Embedding as a batch job (E-01 .. E-04)."""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C
from ..functions import text as X
from ..session import materialise

# A model: texts in, one vector per text out. The factory runs once per Python worker task.
Model = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed(df: DataFrame, text: str, factory: Callable[[], Model], prefix: str = C.DOCUMENT_PREFIX,
          batch: int = C.EMBED_BATCH, attempts: int = C.EMBED_ATTEMPTS, wait: float = 1.0) -> DataFrame:
    """E-01, E-02: add ``embedding`` (unit length) and ``embed_error``.

    A failing batch is tried again after 2^n waits; when the last attempt fails
    each of its rows carries the error instead of a vector.
    """

    @F.pandas_udf("struct<embedding:array<float>,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for texts in batches:
            vectors, errors = [], []
            for i in range(0, len(texts), batch):
                part = [prefix + t for t in texts.iloc[i:i + batch].fillna("")]
                for attempt in range(attempts):
                    try:
                        m = np.asarray(model(part), dtype=np.float64)
                        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
                        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
                        vectors += list(m.astype("float32"))
                        errors += [None] * len(part)
                        break
                    except Exception as error:  # noqa: BLE001 - reported per row
                        if attempt + 1 == attempts:
                            vectors += [None] * len(part)
                            errors += [f"{type(error).__name__}: {error}"] * len(part)
                        else:
                            time.sleep(wait * 2 ** attempt)
            yield pd.DataFrame({"embedding": vectors, "error": pd.Series(errors, dtype=object)})

    out = df.withColumn("__e", run(F.col(text)))
    return out.withColumn("embedding", F.col("__e.embedding")).withColumn("embed_error", F.col("__e.error")).drop("__e")


def embedding_records(embedded: DataFrame, model_id: str, text: str = "embedding_text") -> DataFrame:
    """E-03: records of the rows that got a vector; the hash is that of the embedded text."""
    return embedded.where(F.col("embed_error").isNull()).select(
        "chunk_id", "document_id", "source_id", F.lit(C.SCHEMA_VERSION).alias("schema_version"),
        F.lit(model_id).alias("model_id"), F.size("embedding").alias("dimension"),
        X.sha256_tag(F.col(text)).alias("embedding_text_sha256"), "embedding",
        F.current_timestamp().alias("embedded_at"))


def embedding_counts(embedded: DataFrame) -> DataFrame:
    """E-03: embedded and failed rows per document."""
    return embedded.groupBy("document_id").agg(
        F.count_if(F.col("embed_error").isNull()).alias("embedded"),
        F.count_if(F.col("embed_error").isNotNull()).alias("failed"))


class HashedTfidf:
    """The Spark-native embedder: hashed term frequencies, inverse document frequency, unit length."""

    def __init__(self, dimension: int = 256):
        self.dimension, self.model = dimension, None

    def fit(self, df: DataFrame, text: str) -> "HashedTfidf":
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import IDF, HashingTF, Normalizer

        stages = [
            HashingTF(inputCol="__w", outputCol="__tf", numFeatures=self.dimension),
            IDF(inputCol="__tf", outputCol="__idf"), Normalizer(inputCol="__idf", outputCol="__unit")]
        self.model = Pipeline(stages=stages).fit(df.select(X.words(F.col(text)).alias("__w")))
        return self

    def transform(self, df: DataFrame, text: str, prefix: str = "") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        worded = df.withColumn("__w", X.words(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))))
        out = self.model.transform(worded)
        return out.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__w", "__tf", "__idf", "__unit")


def embed_queries(queries: DataFrame, embedder, text: str = "query_text") -> tuple[DataFrame, DataFrame]:
    """E-04: (embedded queries, rejected blank queries)."""
    from .topk import split_blank

    usable, rejected = split_blank(queries, text)
    usable = usable.withColumn(text, X.strip(F.col(text)))
    if isinstance(embedder, HashedTfidf):
        return embedder.transform(usable, text), rejected
    return embed(usable, text, embedder, prefix=C.QUERY_PREFIX), rejected


class EmbeddingRun:
    """E-02 as a job that can be taken up again: vectors in one table, failed batches in a dead-letter table.

    Rows belong to batches of a key that stays the same (``batch``). A batch fails as a whole; its rows and the error go to the dead
    letters, with the number of the attempt, and ``resume`` embeds only batches that have no vectors yet. Tables are written per
    attempt, whole or not at all.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "chunk_id", batch: str = "batch"):
        self.spark, self.folder, self.key, self.batch = spark, folder, key, batch

    def _attempts(self, name: str) -> list[int]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(place)] if fs.exists(place) else []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("attempt=") and fs.exists(done(p, "_SUCCESS")))

    def _read(self, name: str, schema: str) -> DataFrame:
        attempts = self._attempts(name)
        if not attempts:
            return self.spark.createDataFrame([], f"{schema}, attempt int")
        return self.spark.read.schema(f"{schema}, attempt int").option("basePath", f"{self.folder}/{name}").parquet(
            *[f"{self.folder}/{name}/attempt={n}" for n in attempts])

    def _keys(self, rows: DataFrame) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        return f"{self.key} {kinds[self.key]}, {self.batch} {kinds[self.batch]}"

    def vectors(self, rows: DataFrame) -> DataFrame:
        return self._read("vectors", f"{self._keys(rows)}, embedding array<float>")

    def dead_letters(self, rows: DataFrame) -> DataFrame:
        """key, batch, error and attempt of all failures, also of batches that have recovered since."""
        return self._read("dead", f"{self._keys(rows)}, error string")

    def resume(self, rows: DataFrame, text: str, factory: Callable[[], Model], prefix: str = C.DOCUMENT_PREFIX) -> int:
        """Embed the batches of rows (key, batch, text) that have no vectors yet. Returns the number of the attempt."""
        done = self.vectors(rows).select(self.batch).distinct()
        attempt = max([0, *self._attempts("vectors"), *self._attempts("dead")]) + 1
        open_ = rows.select(self.key, self.batch, F.coalesce(text, F.lit("")).alias("__text")).join(done, self.batch, "left_anti")
        kinds = self._keys(rows)
        key, batch = self.key, self.batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, held = factory(), None
            for frame in frames:
                held = frame if held is None else pd.concat([held, frame])
                last = held[batch].iloc[-1]
                whole = held[held[batch] != last]  # the last batch may go on
                held = held[held[batch] == last]
                for _, own in whole.groupby(batch, sort=False):
                    yield one(model, own)
            if held is not None and len(held):
                yield one(model, held)

        def one(model, own: pd.DataFrame) -> pd.DataFrame:
            out = own[[key, batch]].copy()
            try:
                m = np.asarray(model([prefix + t for t in own["__text"]]), dtype=np.float64)
                size = np.sqrt((m * m).sum(axis=1, keepdims=True))
                out["embedding"] = list(np.divide(m, size, out=np.zeros_like(m), where=size > 0).astype("float32"))
                out["error"] = None
            except Exception as error:  # noqa: BLE001 - reported per row
                out["embedding"] = None
                out["error"] = f"{type(error).__name__}: {error}"
            return out

        dealt = open_.repartition(batch).sortWithinPartitions(batch, key)
        found = materialise(dealt.mapInPandas(run, f"{kinds}, embedding array<float>, error string"), "embedded")
        found.where("error is null").drop("error").write.mode("overwrite").parquet(f"{self.folder}/vectors/attempt={attempt}")
        found.where("error is not null").drop("embedding").write.mode("overwrite").parquet(f"{self.folder}/dead/attempt={attempt}")
        return attempt

    def report(self, rows: DataFrame) -> DataFrame:
        """batch, rows, failed_attempts, embedded_in (null if never) and last error of every batch."""
        total = rows.groupBy(self.batch).agg(F.count("*").alias("rows"))
        failed = self.dead_letters(rows).groupBy(self.batch).agg(F.count_distinct("attempt").alias("failed_attempts"), F.max_by("error", "attempt").alias("last_error"))
        done = self.vectors(rows).groupBy(self.batch).agg(F.max("attempt").alias("embedded_in"))
        return total.join(failed, self.batch, "left").join(done, self.batch, "left").select(
            self.batch, "rows", F.coalesce("failed_attempts", F.lit(0)).alias("failed_attempts"), "embedded_in", "last_error")
