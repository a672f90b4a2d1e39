"""Upserts, checked appends, parity and ledgers."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import normalise
from ..session import checkpoint_folder
from ..sources import readers, writers
from ..streaming import logs
from . import query
from .common import table, table_stream


def _base(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"), F.length("text").alias("size"))


def _incoming(spark, d):
    """Labelled documents come again with a new size, and some new ones with them; labels repeat."""
    rows = table(spark, d, "labels").select(F.col("doc_id"), F.lit("relabelled").alias("source_id"), (F.col("quality") * 10 + F.col("toxic")).alias("size"))
    extra = table(spark, d, "benchmark").select((F.col("item_id") + 10_000_000).alias("doc_id"), F.lit("bench").alias("source_id"), F.length("text").alias("size"))
    return rows.unionByName(extra)


@query("upsert_chunks", """
select doc_id, source source_id, length(text)::int as "size" from documents where doc_id not in (select doc_id from labels)
union all select doc_id, 'relabelled', (quality * 10 + toxic)::int from labels
union all select item_id + 10000000, 'bench', length(text)::int from benchmark""")
def upsert_chunks(spark, d):
    return writers.upsert(_base(spark, d), _incoming(spark, d), ["doc_id"])


@query("upsert_keep_cache_id", """
with base as (select user_id, event_type, min(event_id) cache_id, 'old' answer from events where event_type <> 'view' group by 1, 2),
incoming as (select user_id, event_type, max(event_id) cache_id, 'new' answer from events where event_type in ('view', 'click') group by 1, 2)
select coalesce(b.user_id, i.user_id) user_id, coalesce(b.event_type, i.event_type) event_type, coalesce(b.cache_id, i.cache_id) cache_id,
  coalesce(i.answer, b.answer) answer from base b full join incoming i on i.user_id = b.user_id and i.event_type = b.event_type""")
def upsert_keep_cache_id(spark, d):
    events = table(spark, d, "events")
    base = events.where("event_type <> 'view'").groupBy("user_id", "event_type").agg(F.min("event_id").alias("cache_id")).withColumn("answer", F.lit("old"))
    new = events.where("event_type in ('view', 'click')").select("user_id", "event_type", F.col("event_id").alias("cache_id"), F.lit("new").alias("answer"))
    return writers.upsert(base, new, ["user_id", "event_type"], keep=["cache_id"], order="cache_id")


@query("versioned_upserts", """
select doc_id, source source_id, length(text)::int as "size" from documents where doc_id not in (select doc_id from labels)
union all select doc_id, 'relabelled', (quality * 10 + toxic)::int from labels
union all select item_id + 10000000, 'bench', length(text)::int from benchmark""")
def versioned_upserts(spark, d):
    """The same, through a table bucketed by key; the second load of the same rows changes nothing."""
    path = f"{checkpoint_folder(spark)}/attest/table-{uuid.uuid4().hex}"
    writers.upsert_buckets(path, _base(spark, d), ["doc_id"], "size", 8)
    for _ in range(2):
        writers.upsert_buckets(path, _incoming(spark, d), ["doc_id"], "size", 8)
    return writers.read_buckets(spark, path)


@query("stream_upserts", "select conv_id, turn, role from conversations")
def stream_upserts(spark, d):
    """Conversations arrive as a stream of files and are upserted by key."""
    place = f"{checkpoint_folder(spark)}/attest/increments-{uuid.uuid4().hex}"
    rows = table_stream(spark, d, "conversations").select("conv_id", "turn", "role")
    logs.load_increments(rows, f"{place}/table", ["conv_id", "turn"], f"{place}/state", "role").awaitTermination()
    return writers.read_buckets(spark, f"{place}/table", rows.schema)


LATEST_SQL = """
select user_id, event_type, event_id, value as "value" from (
  select *, row_number() over (partition by user_id, event_type order by event_id desc) n from events) where n = 1"""


def _batches(spark, d):
    """All events in three batches, dealt out by a hash and given in another order than that of their ids."""
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    third = F.pmod(F.xxhash64("event_id", "user_id"), F.lit(3))
    return [rows.where(third == n) for n in (2, 0, 1)]


@query("shuffled_batches", LATEST_SQL)
def shuffled_batches(spark, d):
    """The last event of each user and type, from batches in any order: an older row never replaces a newer one."""
    path = f"{checkpoint_folder(spark)}/attest/table-{uuid.uuid4().hex}"
    for batch in _batches(spark, d):
        writers.upsert_buckets(path, batch, ["user_id", "event_type"], buckets=8, version="event_id")
    return writers.read_buckets(spark, path)


@query("stream_shuffled_batches", LATEST_SQL)
def stream_shuffled_batches(spark, d):
    """The same from a stream that takes one of the three files at a time."""
    place = f"{checkpoint_folder(spark)}/attest/increments-{uuid.uuid4().hex}"
    for n, batch in enumerate(_batches(spark, d)):
        batch.coalesce(1).write.parquet(f"{place}/in/batch={n}")
    rows = spark.readStream.schema(_batches(spark, d)[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{place}/in")
    logs.load_increments(rows, f"{place}/table", ["user_id", "event_type"], f"{place}/state", version="event_id").awaitTermination()
    return writers.read_buckets(spark, f"{place}/table")


def _feedback(spark, d):
    n = F.col("turn")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(n % 5 == 4, F.lit(None)).otherwise(F.col("conv_id")).alias("cache_id"),
        F.when(F.col("role") == "system", "so_so").when(n % 2 == 0, "helpful").otherwise("not_helpful").alias("rating"),
        F.when(n % 3 == 0, "  ").otherwise(F.concat(F.lit(" note "), "turn")).alias("comment"))


FEEDBACK_SQL = """
f as (select conv_id, turn, case when turn % 5 <> 4 then conv_id end cache_id, role = 'system' bad, case when turn % 2 = 0 then 'helpful' else 'not_helpful' end rating,
  case when turn % 3 <> 0 then 'note ' || turn end "comment" from conversations),
parents as (select doc_id cache_id from labels)
"""


@query("checked_feedback", f"""with {FEEDBACK_SQL}
select conv_id, turn, rating, "comment" from f where not bad and cache_id in (select cache_id from parents)""")
def checked_feedback(spark, d):
    parents = table(spark, d, "labels").select(F.col("doc_id").alias("cache_id"))
    valid, _ = writers.checked_feedback(_feedback(spark, d), parents)
    return valid.select("conv_id", "turn", "rating", "comment")


@query("constraint_rejects", f"""with {FEEDBACK_SQL}
select conv_id, turn, array_to_string(list_filter([case when bad then 'rating_domain' end, case when cache_id is null then 'cache_id_required' end,
  case when not bad and cache_id is not null then 'unknown_reference' end], lambda x: x is not null), ',') violations
from f where bad or cache_id is null or cache_id not in (select cache_id from parents)""")
def constraint_rejects(spark, d):
    parents = table(spark, d, "labels").select(F.col("doc_id").alias("cache_id"))
    _, rejected = writers.checked_feedback(_feedback(spark, d), parents)
    return rejected.select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


@query("score_rejects", """
select doc_id, array_to_string(list_filter([case when doc_id % 7 = 0 then 'groundedness_range' end, case when doc_id % 6 = 5 then 'relevance_range' end],
  lambda x: x is not null), ',') violations from labels where doc_id % 7 = 0 or doc_id % 6 = 5""")
def score_rejects(spark, d):
    rows = table(spark, d, "labels").select(
        "doc_id", F.col("doc_id").alias("cache_id"), (F.col("doc_id") % 7).cast("int").alias("groundedness"),
        (F.col("doc_id") % 6 + 1).cast("int").alias("relevance"), F.lit(" ").alias("notes"))
    rows = rows.withColumn("groundedness", F.when(F.col("groundedness") == 6, 5).otherwise(F.col("groundedness")))
    parents = table(spark, d, "documents").select(F.col("doc_id").alias("cache_id"))
    _, rejected = writers.checked_scores(rows, parents, ("groundedness", "relevance"))
    return rejected.select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("key_parity", """
select doc_id, 'right' missing_in from documents where doc_id not in (select vec_id from embeddings)
union all select vec_id, 'left' from embeddings where vec_id not in (select doc_id from documents)""")
def key_parity(spark, d):
    return readers.key_parity(
        table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("batch_lookup", """
select d.doc_id, n_chars, len(embedding)::int dimension from documents d join embeddings on vec_id = d.doc_id where d.doc_id in (select doc_id from labels)""")
def batch_lookup(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = readers.lookup(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", vectors)
    return out.select("doc_id", "n_chars", F.size("embedding").alias("dimension"))


@query("policy_defaults", """
select doc_id, case source when 'src0' then 'primary_governing' when 'src1' then 'supporting_process' else 'unknown' end authority_tier,
  case source when 'src0' then 'historical' else 'current_candidate' end currency_status from documents""")
def policy_defaults(spark, d):
    policies = readers.policy_table(spark, {
        "src0": {"authority_tier": "primary_governing", "currency_status": "historical"}, "src1": {"authority_tier": "supporting_process"}})
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"))
    out = readers.with_defaults(rows, policies, {"authority_tier": "unknown", "currency_status": "current_candidate"})
    return out.select("doc_id", "authority_tier", "currency_status")


@query("stage_ledger", """
select 'chunk' stage, 'd' || doc_id document_id, case when lang not in ('en', 'fr', 'de') then 'failed' when n_chars < 20 then 'skipped' else 'success' end status,
  case when lang not in ('en', 'fr', 'de') then 'Unsupported source type: ' || lang end as "error",
  case when lang in ('en', 'fr', 'de') and n_chars >= 20 then n_chars end as "count"
from documents""")
def stage_ledger(spark, d):
    kind = F.when(F.col("lang").isin("en", "fr", "de"), "html").otherwise(F.col("lang"))
    rows = normalise.route(table(spark, d, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("document_id"), kind.alias("source_type"), F.col("n_chars").alias("count")))
    good = rows.where("error is null")
    return writers.ledger(
        "chunk", ok=good.where("count >= 20").select("document_id", "count"), failed=rows.where("error is not null").select("document_id", "error"),
        skipped=good.where("count < 20").select("document_id")).drop("at")
