"""Shared pieces of the queries: tables, parts held out, and columns of Arrow batches."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise, released

__all__ = ["materialise", "released", "table", "remainder", "per_row", "sampled", "small_batches"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def remainder(column: str, n: int) -> Column:
    """crc32 of a column's text modulo n; a null counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at most, picked by a hash of the key: the bound on what a classifier learns from.

    All rows if there are no more. The same keys are picked however the rows are dealt out.
    """
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session to BATCH_BYTES: batches hold whole texts, some of them very long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def per_row(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Map Arrow batches to Arrow batches; `make` builds the function once in every task."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)
