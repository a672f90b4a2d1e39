"""Cache and usage tables (M-01 .. M-13)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import text as X
from .topk import require_positive


def config_hash(prompt_version: Column, top_k: Column, retrieval_config_id: Column) -> Column:
    """M-01: hash of the key-sorted JSON text of the three settings."""
    text = F.format_string(
        '{"prompt_version": "%s", "retrieval_config_id": "%s", "top_k": %d}', prompt_version, retrieval_config_id, top_k)
    return F.sha2(text, 256)


def cache_split(questions: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M-02: (hits with their cached answer, misses) by question text and configuration."""
    keys = ["question_text", "config_hash"]
    asked = questions.withColumn("question_text", X.strip(F.col("question_text")))
    return asked.join(cache, keys), asked.join(cache.select(*keys), keys, "left_anti")


def cached_by_id(cache: DataFrame, ids: DataFrame) -> DataFrame:
    """M-03: cached answers of a batch of ids."""
    return cache.join(ids.select("cache_id"), "cache_id", "left_semi")


def recent(log: DataFrame, n: int = 20, at: str = "created_at", key: str = "cache_id") -> DataFrame:
    """M-04: the latest n rows; every task passes on n rows at most."""
    require_positive(n=n)
    return log.orderBy(F.desc(at), F.asc(key)).limit(n)


def usage_totals(cache: DataFrame, feedback: DataFrame, scores: DataFrame) -> DataFrame:
    """M-05: one row of totals."""
    parts = [
        cache.agg(F.count("*").alias("cached_queries")), feedback.agg(F.count("*").alias("feedback_events")),
        scores.agg(F.count("*").alias("manual_reviews"), F.count_if(F.col("is_tier2")).alias("tier2_reviews"))]
    return one_row(parts)


def one_row(parts: list[DataFrame]) -> DataFrame:
    """One-row tables side by side: stacked, then taken column by column."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def status_distribution(log: DataFrame, status: str = "answer_status") -> DataFrame:
    """M-06: counts, largest first."""
    return log.groupBy(status).agg(F.count("*").alias("query_count")).orderBy(F.desc("query_count"), F.asc(status))


def rating_distribution(feedback: DataFrame) -> DataFrame:
    """M-07."""
    return feedback.groupBy("rating").agg(F.count("*").alias("feedback_count")).orderBy("rating")


def score_means(scores: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """M-08: mean per score field, in long form."""
    means = scores.agg(*[F.round(F.avg(f), 2).alias(f) for f in fields])
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("mean_score")) for f in fields])
    return means.select(F.explode(items).alias("m")).select("m.*")


def latency_series(log: DataFrame) -> DataFrame:
    """M-09."""
    return log.where(F.col("latency_ms").isNotNull()).select("created_at", "answer_status", "latency_ms").orderBy("created_at")


def latency_by_status(log: DataFrame) -> DataFrame:
    """M-10."""
    return log.where(F.col("latency_ms").isNotNull()).groupBy("answer_status").agg(
        F.avg("latency_ms").alias("mean_latency_ms"), F.count("*").alias("query_count")
    ).orderBy(F.desc("mean_latency_ms"))


def daily_volume(log: DataFrame) -> DataFrame:
    """M-11."""
    return log.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("query_count")).orderBy("day")


def review_coverage(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """M-12: reviews per question of the set, zero included, and the share of questions reviewed."""
    counts = scores.where(F.col("is_tier2") & F.col("question_id").isNotNull()).groupBy("question_id").agg(
        F.count("*").alias("review_count"))
    return questions.select("question_id").join(counts, "question_id", "left").na.fill(0, ["review_count"])


def coverage_rate(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.count_if(F.col("review_count") > 0).alias("reviewed"), F.count("*").alias("total"),
        (F.count_if(F.col("review_count") > 0) / F.count("*")).alias("coverage"))


def status_label(status: Column) -> Column:
    """M-13."""
    labels = F.create_map(*[F.lit(x) for kv in C.STATUS_LABELS.items() for x in kv])
    return F.coalesce(labels[status], F.lit(C.DEFAULT_STATUS_LABEL))
