"""Usage tables over the event log: type is the answer status, value the latency."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import monitor
from ..session import checkpoint_folder
from ..streaming import logs
from . import query
from .common import table, table_stream

FIELDS = ("groundedness", "relevance", "completeness", "citation_quality", "appropriate_uncertainty")


def query_log(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("cache_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("answer_status"),
        F.when(F.col("event_id") % 12 != 0, F.col("value")).alias("latency_ms"))


LOG_SQL = "log as (select event_id cache_id, ts created_at, event_type answer_status, case when event_id % 12 <> 0 then value end latency_ms from events)"


def reviews(spark, d):
    e = F.col("doc_id")
    return table(spark, d, "labels").select(
        F.concat(F.lit("t"), e % 30).alias("question_id"), (F.col("quality") == 1).alias("is_tier2"),
        *[(1 + F.floor(e / n) % 5).cast("int").alias(f) for n, f in zip((1, 2, 3, 5, 7), FIELDS)])


@query("recent_queries", f"with {LOG_SQL} select cache_id, created_at, answer_status from log order by created_at desc, cache_id limit 20")
def recent_queries(spark, d):
    return monitor.recent(query_log(spark, d), 20).select("cache_id", "created_at", "answer_status")


@query("usage_totals", """
select (select count(*) from events) cached_queries, (select count(*) from conversations) feedback_events,
  (select count(*) from labels) manual_reviews, (select count(*) filter (quality = 1) from labels) tier2_reviews""")
def usage_totals(spark, d):
    return monitor.usage_totals(query_log(spark, d), table(spark, d, "conversations"), reviews(spark, d))


@query("status_distribution", f"with {LOG_SQL} select answer_status, count(*) query_count from log group by 1")
def status_distribution(spark, d):
    return monitor.status_distribution(query_log(spark, d))


@query("rating_distribution", "select case when toxic = 0 then 'helpful' else 'not_helpful' end rating, count(*) feedback_count from labels group by 1")
def rating_distribution(spark, d):
    rows = table(spark, d, "labels").select(F.when(F.col("toxic") == 0, "helpful").otherwise("not_helpful").alias("rating"))
    return monitor.rating_distribution(rows)


@query("score_means_long", "with s as (select " + ", ".join(
    f"round(avg(1 + (doc_id // {n}) % 5), 2) {f}" for n, f in zip((1, 2, 3, 5, 7), FIELDS)) + " from labels) "
    + " union all ".join(f"select '{f}' field, {f} mean_score from s" for f in FIELDS))
def score_means_long(spark, d):
    return monitor.score_means(reviews(spark, d), FIELDS)


@query("latency_series", f"with {LOG_SQL} select created_at, answer_status, latency_ms from log where latency_ms is not null")
def latency_series(spark, d):
    return monitor.latency_series(query_log(spark, d))


@query("latency_by_status", f"with {LOG_SQL} select answer_status, round(avg(latency_ms), 6) mean_latency_ms, count(*) query_count from log where latency_ms is not null group by 1")
def latency_by_status(spark, d):
    return monitor.latency_by_status(query_log(spark, d)).withColumn("mean_latency_ms", F.round("mean_latency_ms", 6))


@query("daily_volume", f'with {LOG_SQL} select created_at::date as "day", count(*) query_count from log group by 1')
def daily_volume(spark, d):
    return monitor.daily_volume(query_log(spark, d))


COVERAGE_SQL = """
questions as (select distinct 't' || (doc_id % 37) question_id from documents),
coverage as (
  select q.question_id, count(l.doc_id) review_count from questions q
  left join labels l on 't' || (l.doc_id % 30) = q.question_id and quality = 1 group by 1)
"""


def _coverage(spark, d):
    questions = table(spark, d, "documents").select(F.concat(F.lit("t"), F.col("doc_id") % 37).alias("question_id")).distinct()
    return monitor.review_coverage(reviews(spark, d), questions)


@query("review_coverage", f"with {COVERAGE_SQL} select * from coverage")
def review_coverage(spark, d):
    return _coverage(spark, d)


@query("review_coverage_rate", f"with {COVERAGE_SQL} select count(*) filter (review_count > 0) reviewed, count(*) total, count(*) filter (review_count > 0) / count(*) coverage from coverage")
def review_coverage_rate(spark, d):
    return monitor.coverage_rate(_coverage(spark, d))


@query("config_hashes", """
select event_type, k, sha256('{"prompt_version": "' || event_type || '", "retrieval_config_id": "default", "top_k": ' || k || '}') config_hash, n
from (select event_type, event_id % 4 + 1 k, count(*) n from events group by 1, 2)""")
def config_hashes(spark, d):
    rows = table(spark, d, "events").groupBy("event_type", (F.col("event_id") % 4 + 1).alias("k")).agg(F.count("*").alias("n"))
    return rows.withColumn("config_hash", monitor.config_hash(F.col("event_type"), F.col("k"), F.lit("default")))


def _cache(spark, d):
    e = F.col("event_id")
    asked = table(spark, d, "events").select(
        e.alias("request_id"), F.concat(F.lit("  question "), "user_id", F.lit(" ")).alias("question_text"),
        monitor.config_hash(F.col("event_type"), F.lit(10), F.lit("default")).alias("config_hash"))
    cache = table(spark, d, "events").where("event_type in ('view', 'click') and user_id % 3 = 0").groupBy("user_id", "event_type").agg(
        F.min("event_id").alias("cache_id")).select(
        F.concat(F.lit("question "), "user_id").alias("question_text"),
        monitor.config_hash(F.col("event_type"), F.lit(10), F.lit("default")).alias("config_hash"), "cache_id")
    return asked, cache


CACHE_SQL = """
cache as (select user_id, event_type, min(event_id) cache_id from events where event_type in ('view', 'click') and user_id % 3 = 0 group by 1, 2)
"""


@query("cache_hits", f"with {CACHE_SQL} select e.event_id request_id, cache_id from events e join cache c on c.user_id = e.user_id and c.event_type = e.event_type")
def cache_hits(spark, d):
    hits, _ = monitor.cache_split(*_cache(spark, d))
    return hits.select("request_id", "cache_id")


@query("cache_misses", f"""with {CACHE_SQL} select event_id request_id from events e where not exists (select 1 from cache c where c.user_id = e.user_id and c.event_type = e.event_type)""")
def cache_misses(spark, d):
    _, misses = monitor.cache_split(*_cache(spark, d))
    return misses.select("request_id")


@query("cached_by_id", f"with {LOG_SQL} select cache_id, answer_status from log where cache_id in (select doc_id from labels)")
def cached_by_id(spark, d):
    return monitor.cached_by_id(query_log(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("cache_id"))).select("cache_id", "answer_status")


@query("status_labels", """
select event_id, case event_id % 6 when 0 then 'Answered' when 1 then 'Partial' when 2 then 'Needs clarification'
  when 3 then 'Insufficient evidence' when 4 then 'High-stakes boundary' else 'Answered' end as "label" from events""")
def status_labels(spark, d):
    names = F.array(*[F.lit(s) for s in C.STATUS_LABELS], F.lit("unheard_of"))
    status = F.element_at(names, (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", monitor.status_label(status).alias("label"))


@query("stream_daily_status", """
with w as (select date_trunc('day', ts) as "day", event_type answer_status, count(*) query_count, round(avg(value), 6) mean_latency_ms from events group by 1, 2)
select strftime("day", '%Y-%m-%d') as "day", answer_status, query_count, mean_latency_ms from w
where "day" + interval 1 day <= (select max(ts) - interval 1 hour from events)""")
def stream_daily_status(spark, d):
    """The event log read as a stream to its end; days still open under the watermark are not out yet."""
    import uuid

    log = table_stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("answer_status"), F.col("value").alias("latency_ms"))
    place = f"{checkpoint_folder(spark)}/attest/stream-{uuid.uuid4().hex}"
    run = (logs.daily_status(log).writeStream.outputMode("append").format("parquet").option("path", f"{place}/out")
           .option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.parquet(f"{place}/out").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "answer_status", "query_count", F.round("mean_latency_ms", 6).alias("mean_latency_ms"))
