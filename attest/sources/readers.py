"""Readers (S-01 .. S-03, S-11 .. S-15)."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..operators.topk import last_wins


class EmptyInput(RuntimeError):
    pass


def read_json_docs(spark: SparkSession, path: str, schema: T.StructType, exclude: Sequence[str] = (),
                   items: str | None = None) -> DataFrame:
    """S-01: a folder with one JSON document per file, report files left out.

    ``items`` names an array of the document to explode into rows.
    """
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file_name"))
    if exclude:
        rows = rows.where(~F.col("file_name").isin(*exclude))
    if rows.isEmpty():
        raise EmptyInput(f"no JSON documents in {path}")
    if items is None:
        return rows
    kept = [c for c in rows.columns if c not in (items, "file_name")]
    names = schema[items].dataType.elementType.names
    outer = [F.col(c).alias(f"document_{c}" if c in names else c) for c in kept]
    return rows.select(*outer, F.explode(items).alias("__item")).select(
        *[c for c in (f"document_{c}" if c in names else c for c in kept)], "__item.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S-02: JSON lines; blank lines are skipped, a missing path raises."""
    return spark.read.schema(schema).json(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """S-03: the last record per chunk wins, in file and line order.

    A line's place is its position in the file split that holds it, taken at read time.
    """
    rows = spark.read.schema(schemas.EMBEDDING).json(path).select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__line"))
    return last_wins(rows, ["chunk_id"], ["__file", "__split", "__line"]).drop("__file", "__split", "__line")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """S-15: question set; absent lists are empty."""
    rows = read_jsonl(spark, path, schemas.QUESTION)
    none = F.array().cast("array<string>")
    return rows.withColumn("expected_sources", F.coalesce("expected_sources", none)).withColumn(
        "expected_topics", F.coalesce("expected_topics", none))


def policy_table(spark: SparkSession, policies: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """S-14: source policies as a local table; its size is that of the configuration."""
    rows = [(s, p.get("authority_tier"), p.get("retrieval_tier"), p.get("currency_status")) for s, p in policies.items()]
    return spark.createDataFrame(rows, "source_id string, authority_tier string, retrieval_tier string, currency_status string")


def with_defaults(rows: DataFrame, settings: DataFrame, default: Mapping[str, object], key: str = "source_id") -> DataFrame:
    """S-14: join settings per source; what a source leaves open takes the default."""
    out = rows.join(settings, key, "left")
    for name, value in default.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in out.columns else F.lit(value))
    return out


def split_eligible(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-11: (sources to extract, skipped sources with both statuses)."""
    fit = F.coalesce("eligible_for_extraction", F.lit(False))
    skipped = sources.where(~fit).select(
        F.col("id").alias("document_id"), F.lit("skipped").alias("status"), "validation_status",
        F.col("manual_review.status").alias("review_status"))
    return sources.where(fit), skipped


def lookup(rows: DataFrame, keys: DataFrame, key: str, vectors: DataFrame | None = None) -> DataFrame:
    """S-13: the rows of a batch of keys, with their vectors when given."""
    found = rows.join(keys.select(key), key, "left_semi")
    return found if vectors is None else found.join(vectors.select(key, "embedding"), key)


def key_parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """S-12: keys that only one side holds."""
    return a.select(key).join(b.select(key), key, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(
        b.select(key).join(a.select(key), key, "left_anti").withColumn("missing_in", F.lit("left")))
