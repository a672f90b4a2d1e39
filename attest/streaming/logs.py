"""Streaming forms of the usage aggregates and of incremental loading (W-01, W-02)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import upsert_buckets


def daily_status(log: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """W-01: count and mean latency per day and status; rows later than the watermark are dropped.

    State holds one counter per open day and status, whatever the volume.
    """
    return (
        log.withWatermark("created_at", late)
        .groupBy(F.window("created_at", width).alias("w"), "answer_status")
        .agg(F.count("*").alias("query_count"), F.avg("latency_ms").alias("mean_latency_ms"))
        .select(F.col("w.start").alias("day"), "answer_status", "query_count", "mean_latency_ms"))


def read_increments(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def load_increments(rows: DataFrame, table: str, keys: Sequence[str], checkpoint: str, order: str | None = None,
                    at: str | None = None, late: str = "1 hour", version: str | None = None) -> StreamingQuery:
    """W-02: each batch of new files is upserted into a table bucketed by key; ``order`` picks the last row of a key in a batch.

    With ``version`` a column of the rows orders them across batches as well: a late older row never replaces a newer one. With an event time, equal rows within the watermark are dropped first; a new
    row for a known key always goes through. A batch that is run again replaces
    the same keys by the same rows.
    """
    if at is not None:
        rows = rows.withWatermark(at, late).dropDuplicatesWithinWatermark()

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            upsert_buckets(table, batch, keys, order, version=version)

    return (rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
