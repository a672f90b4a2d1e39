"""Source registry over documents: one document is one source; labelled ones were seen before."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry
from . import query
from .common import table


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def files(spark, d):
    """Documents as files: every fifth a pdf, half of those with a wrong signature."""
    n = F.col("doc_id")
    kind = F.when(n % 5 == 0, "pdf").when(n % 97 == 1, "feed").otherwise("html")
    head = F.when(n % 10 == 0, F.lit("%PDF-1.7 Cancelling Revised Cal. PUC Sheet No. 12-E ")).otherwise(F.lit(""))
    return table(spark, d, "documents").select(
        F.concat(F.lit("s"), n).alias("id"), "doc_id", kind.alias("type"), F.concat(head, "text").cast("binary").alias("content"))


FILES_SQL = """
files as (
  select 's' || doc_id id, doc_id, case when doc_id % 5 = 0 then 'pdf' when doc_id % 97 = 1 then 'feed' else 'html' end type,
    case when doc_id % 10 = 0 then '%PDF-1.7 Cancelling Revised Cal. PUC Sheet No. 12-E ' else '' end || text content from documents),
checked as (
  select *, 'sha256:' || sha256(content) content_hash, case when type = 'pdf' then case when starts_with(content, '%PDF') then 'passed' else 'failed' end
    when type = 'html' then 'passed' end validation_status from files)
"""


@query("file_validation", f"with {FILES_SQL} select id, content_hash, validation_status, case when type = 'feed' then 'Unknown source type: feed' end as \"error\" from checked")
def file_validation(spark, d):
    return registry.validate_signature(files(spark, d)).select("id", "content_hash", "validation_status", "error")


@query("superseded_sheets", f"with {FILES_SQL} select id, case when doc_id % 10 = 0 then '12-E' end superseded_by_sheet from checked")
def superseded_sheets(spark, d):
    return files(spark, d).select("id", registry.superseded_sheet(F.col("content")).alias("superseded_by_sheet"))


@query("chosen_attempts", f"""with {FILES_SQL}
select id, case when type <> 'pdf' or validation_status = 'passed' then 'primary' when doc_id % 3 = 0 then 'primary' else 'fallback' end "method" from checked""")
def chosen_attempts(spark, d):
    n = F.col("doc_id")
    checked = registry.validate_signature(files(spark, d))
    primary = checked.select("id", "type", F.lit("primary").alias("method"), "validation_status")
    second = checked.where((F.col("type") == "pdf") & (F.col("validation_status") == "failed")).select(
        "id", "type", F.lit("fallback").alias("method"), F.when(n % 3 == 0, "not_run").otherwise("failed").alias("validation_status"))
    return registry.chosen_attempt(primary.unionByName(second)).select("id", "method")


def current(spark, d):
    n = F.col("doc_id")
    return registry.validate_signature(files(spark, d)).where("error is null").select(
        "id", "doc_id", "type", "content_hash", "validation_status", (n % 6 != 0).alias("default_retrieval_enabled"),
        F.when(n % 8 == 0, F.lit(True)).alias("is_draft"), F.when(n % 29 == 0, "timeout").alias("fetch_error"))


def previous(spark, d):
    """The last snapshot: labelled documents; those of low quality have changed since."""
    n = F.col("doc_id")
    seen = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    rows = registry.validate_signature(files(spark, d)).where("error is null").join(seen, "doc_id")
    review = F.struct(
        F.lit(False).alias("required"), F.when(F.col("toxic") == 0, "approved").otherwise("pending").alias("status"),
        F.lit("initial_document_review").alias("review_type"), F.lit("seen").alias("reason"), now().alias("reviewed_at"),
        F.lit("r1").alias("reviewer"), F.lit(None).cast("string").alias("notes"))
    return rows.select(
        "id", "type", F.when(F.col("quality") == 1, F.col("content_hash")).otherwise("sha256:old").alias("content_hash"),
        "validation_status", F.lit(True).alias("default_retrieval_enabled"), F.lit(False).alias("is_draft"),
        F.when(n % 4 != 0, review).alias("manual_review"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("downloaded_at"),
        F.lit(True).alias("is_current"), F.lit("current").alias("currency_status"), F.lit("v1").alias("version_label"),
        F.lit(None).cast("string").alias("effective_date"), F.lit(None).cast("string").alias("revision_date"),
        F.lit(None).cast("string").alias("currency_evidence"), F.lit(False).alias("change_detected"), now().alias("last_checked"),
        F.lit(True).alias("eligible_for_extraction"), F.lit(False).alias("eligible_for_default_retrieval"))


NEXT_SQL = f"""{FILES_SQL},
compared as (
  select c.*, l.doc_id is not null seen, l.doc_id is not null and quality <> 1 changed, l.toxic, c.doc_id % 4 <> 0 had_review,
    c.doc_id % 29 = 0 failed
  from checked c left join labels l on l.doc_id = c.doc_id where type <> 'feed'),
stated as (
  select *, case when validation_status = 'failed' then 'failed_download_validation' when not seen then 'initial_document_review'
      when changed then 'content_change' when not had_review then 'metadata_migration_review' else 'initial_document_review' end review_type,
    case when validation_status <> 'failed' and seen and not changed and had_review and toxic = 0 then 'approved' else 'pending' end review_status
  from compared where not failed),
nexts as (
  select id, changed change_detected, review_type, review_status, validation_status = 'passed' eligible_for_extraction,
    validation_status = 'passed' and doc_id % 6 <> 0 and doc_id % 8 <> 0 and review_status = 'approved' eligible_for_default_retrieval,
    case when seen and not changed then 'current' else 'unverified' end currency_status,
    case when seen and not changed then 'v1' end version_label from stated
  union all
  select id, true, case when had_review then 'initial_document_review' end, case when had_review then case when toxic = 0 then 'approved' else 'pending' end end,
    true, false, 'current', 'v1' from compared where failed and seen)
"""


@query("registry_changes", f"with {FILES_SQL} select id, l.doc_id is not null and quality <> 1 change_detected from checked c left join labels l on l.doc_id = c.doc_id where type <> 'feed'")
def registry_changes(spark, d):
    return registry.detect_changes(current(spark, d), previous(spark, d)).select("id", "change_detected")


@query("registry_refresh", f"with {NEXT_SQL} select * from nexts")
def registry_refresh(spark, d):
    out = registry.refresh(current(spark, d), previous(spark, d), now())
    return out.select("id", "change_detected", F.col("manual_review.review_type").alias("review_type"),
                      F.col("manual_review.status").alias("review_status"), "eligible_for_extraction", "eligible_for_default_retrieval",
                      "currency_status", "version_label")


@query("review_queue", f"with {NEXT_SQL} select id document_id, review_type from nexts where review_status = 'pending'")
def review_queue(spark, d):
    return registry.review_queue(registry.refresh(current(spark, d), previous(spark, d), now())).select("document_id", "review_type")


@query("extraction_skipped", f"""with {NEXT_SQL} select id document_id, 'skipped' status, review_status from nexts where not eligible_for_extraction""")
def extraction_skipped(spark, d):
    from ..sources.readers import split_eligible

    _, skipped = split_eligible(registry.refresh(current(spark, d), previous(spark, d), now()))
    return skipped.select("document_id", "status", "review_status")


def _approvals(spark, d):
    """Every eleventh document is replaced by hand; some replacements are of unknown sources."""
    n = F.col("doc_id")
    return table(spark, d, "documents").where(n % 11 == 0).select(
        F.when(n % 2 == 0, F.concat(F.lit("s"), n)).otherwise(F.concat(F.lit("x"), n)).alias("id"), F.lit("r2").alias("reviewer"),
        F.concat(F.lit("%PDF new "), "text").cast("binary").alias("content"))


@query("manual_approvals", f"""with {NEXT_SQL}
select n.id, a.doc_id is not null replaced, case when a.doc_id is not null then 'approved' else review_status end review_status,
  case when a.doc_id is not null then 'sha256:' || sha256('%PDF new ' || text) end new_hash
from nexts n left join documents a on 's' || a.doc_id = n.id and a.doc_id % 22 = 0""")
def manual_approvals(spark, d):
    approved, _ = registry.approve(registry.refresh(current(spark, d), previous(spark, d), now()), _approvals(spark, d), now())
    hit = F.coalesce(F.col("manual_review.reviewer") == "r2", F.lit(False))
    return approved.select("id", hit.alias("replaced"), F.col("manual_review.status").alias("review_status"),
                           F.when(hit, F.col("content_hash")).alias("new_hash"))


@query("rejected_approvals", f"""with {NEXT_SQL}
select case when doc_id % 2 = 0 then 's' else 'x' end || doc_id id from documents
where doc_id % 11 = 0 and (doc_id % 2 = 1 or 's' || doc_id not in (select id from nexts))""")
def rejected_approvals(spark, d):
    _, rejected = registry.approve(registry.refresh(current(spark, d), previous(spark, d), now()), _approvals(spark, d), now())
    return rejected.select("id")
