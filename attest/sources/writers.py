"""Writers, keyed upserts, checked appends and ledgers (S-04 .. S-10)."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import config as C
from ..functions import text as X
from ..operators.topk import last_wins
from ..session import materialise


class StageFailed(RuntimeError):
    pass


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S-04: one append per batch."""
    df.write.mode("append").format(fmt).save(path)


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S-05."""
    df.write.mode("overwrite").format(fmt).save(path)


def upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), refresh: str | None = None,
           order: str | None = None, version: str | None = None) -> DataFrame:
    """S-06 .. S-08: replace the rows of incoming keys, keep all others.

    ``keep`` columns stay as they were for keys already present; ``refresh`` is
    stamped on incoming rows; ``order`` picks the last incoming row per key. Without
    an order a key that comes twice is an error. ``version`` is an order that is stored
    with the rows and holds across batches, too: an incoming row never replaces one of
    a later version, and of equal versions the incoming one stays, so batches give the same
    table in whatever order they come. A null version is before all others.
    """
    keys = list(keys)
    if version is not None and (order is not None or version in (*keep, refresh) or version not in base.columns):
        raise ValueError("a version is a stored column of its own and the only order")
    order = order or version
    new = last_wins(incoming, keys, [order]) if order else _single(incoming, keys)
    if version is not None:
        there = base.select(*keys, F.struct(version).alias("__there"))
        new = new.join(there, keys, "left").where(F.col("__there").isNull() | (F.struct(version) >= F.col("__there"))).drop("__there")
    if refresh:
        new = new.withColumn(refresh, F.current_timestamp())
    new = new.select(*[c for c in base.columns])
    if keep:
        old = base.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
        new = new.join(old, keys, "left").select(
            *[F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in base.columns])
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def _single(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows, or an error where a key repeats."""
    others = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(F.lit(0).alias("__0"), *others)).alias("__row"))
    repeated = F.raise_error(F.concat(F.lit("an incoming key repeats and no order is given: "), F.to_json(F.struct(*keys))))
    checked = found.withColumn("__n", F.when(F.col("__n") > 1, repeated.cast("long")).otherwise(F.col("__n"))).where("__n = 1")
    return checked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in rows.columns])


BUCKET = "key_bucket"


def upsert_buckets(path: str, incoming: DataFrame, keys: Sequence[str], order: str | None = None, buckets: int = 64, **options) -> None:
    """S-06 .. S-08 on Parquet partitioned by a hash of the key: only buckets with incoming keys are rewritten.

    ``order`` picks within the batch; with ``version`` (see ``upsert``) rows of earlier batches are compared, too.

    The new buckets are written out before any old one is replaced, and running the same batch again gives the same
    table, so a failed write is mended by another run. One writer at a time.
    """
    spark = incoming.sparkSession
    rows = incoming.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    try:
        base = spark.read.schema(rows.schema).parquet(path)
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most `buckets`
        base = base.where(F.col(BUCKET).isin(touched)) if touched else base.limit(0)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        base = spark.createDataFrame([], rows.schema)
    fresh = materialise(upsert(base, rows, keys, order=order, **options), "touched-buckets")
    fresh.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rows of all buckets; with a schema, a table that nothing was written to yet has none."""
    try:
        return spark.read.parquet(path).drop(BUCKET)
    except AnalysisException as e:
        if schema is None or "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


# --- checked appends --------------------------------------------------------------------------


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """S-09: (valid rows, rejected rows with the names of the broken rules). A rule that is null holds."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    rows = df.withColumn("violations", broken)
    return rows.where(F.size("violations") == 0).drop("violations"), rows.where(F.size("violations") > 0)


def split_known(df: DataFrame, parent: DataFrame, key: str, rule: str = "unknown_reference") -> tuple[DataFrame, DataFrame]:
    """S-09: foreign key as semi and anti join."""
    known = parent.select(key)
    lost = df.join(known, key, "left_anti").withColumn("violations", F.array(F.lit(rule)))
    return df.join(known, key, "left_semi"), lost


def checked_feedback(events: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-09: feedback events: rating domain, known cache id, blank comment to null."""
    rows = events.withColumn("comment", X.blank_to_null(F.col("comment")))
    valid, bad = split_valid(rows, {
        "rating_domain": F.col("rating").isNotNull() & F.col("rating").isin(*C.RATINGS),
        "cache_id_required": F.col("cache_id").isNotNull()})
    known, lost = split_known(valid, cache, "cache_id")
    return known, bad.unionByName(lost)


def checked_scores(scores: DataFrame, cache: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """S-09: review scores from 1 to 5, known cache id, blank notes to null."""
    rows = scores.withColumn("notes", X.blank_to_null(F.col("notes")))
    rules = {f"{f}_range": F.col(f).between(1, 5) for f in fields}
    valid, bad = split_valid(rows, {**rules, "cache_id_required": F.col("cache_id").isNotNull()})
    known, lost = split_known(valid, cache, "cache_id")
    return known, bad.unionByName(lost)


# --- ledger -----------------------------------------------------------------------------------


def ledger(stage: str, ok: DataFrame | None = None, failed: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """S-10: stage, document_id, status, error, count, at.

    ``ok``: document_id, count. ``failed``: document_id, error. ``skipped``: document_id.
    """
    parts = []
    for status, df in (("success", ok), ("failed", failed), ("skipped", skipped)):
        if df is None:
            continue
        error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
        count = F.col("count").cast("long") if "count" in df.columns else F.lit(None).cast("long")
        parts.append(df.select(
            F.lit(stage).alias("stage"), F.col("document_id").cast("string").alias("document_id"), F.lit(status).alias("status"),
            error.alias("error"), count.alias("count"), F.current_timestamp().alias("at")))
    if not parts:
        raise ValueError("a ledger needs at least one part")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stage_gate(rows: DataFrame) -> DataFrame:
    """S-10: raise when a document of the stage failed."""
    n = rows.where(F.col("status") == "failed").count()
    if n:
        raise StageFailed(f"{n} documents failed")
    return rows
