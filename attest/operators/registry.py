"""Source registry: snapshots, change detection, review and approval (R-01 .. R-11)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import text as X

CURATED = ("version_label", "effective_date", "revision_date", "currency_evidence")
REVIEW = ("struct<required:boolean,status:string,review_type:string,reason:string,reviewed_at:timestamp,"
          "reviewer:string,notes:string>")

# The reasons written into review records.
REASON_FAILED = "Final downloaded response does not match the configured expected file type."
REASON_NEW = "Validate document identity, version, and currency before enabling default retrieval."
REASON_MIGRATED = "Existing source requires an initial manual review record."
REASON_REPLACED = ("File manually replaced due to automated download block or unreliable source. "
                   "Reviewed and confirmed as valid.")


def content_hash(content: Column) -> Column:
    """R-01."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def signature_status(kind: Column, content: Column) -> Column:
    """R-02: passed or failed; null for a type that is not known."""
    is_pdf = F.substring(content, 1, 4) == F.lit(bytearray(b"%PDF"))
    return F.when(kind == "pdf", F.when(F.coalesce(is_pdf, F.lit(False)), "passed").otherwise("failed")).when(kind == "html", "passed")


def validate_signature(files: DataFrame) -> DataFrame:
    """R-01, R-02: add content_hash, validation_status and error. ``files``: id, type, content."""
    status = signature_status(F.col("type"), F.col("content"))
    return files.withColumn("content_hash", content_hash(F.col("content"))).withColumn("validation_status", status).withColumn(
        "error", F.when(status.isNull(), F.concat(F.lit("Unknown source type: "), F.coalesce("type", F.lit("None")))))


def chosen_attempt(attempts: DataFrame) -> DataFrame:
    """R-03: one attempt per source: the primary if it passed or is no pdf, else the fallback if it ran.

    ``attempts``: id, type, method ('primary'|'fallback'), validation_status ('not_run' when it raised).
    """
    primary = F.col("method") == "primary"
    good = primary & ((F.col("type") != "pdf") | (F.col("validation_status") == "passed"))
    ran = ~primary & (F.col("validation_status") != "not_run")
    weight = F.when(good, 3).when(ran, 2).when(primary, 1).otherwise(0)
    row = F.struct(*[F.col(c) for c in attempts.columns if c != "id"])
    return attempts.groupBy("id").agg(F.max_by(row, weight).alias("r")).select("id", "r.*")


def detect_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """R-04: current rows with the previous record as ``prev`` and ``change_detected``."""
    before = previous.select("id", F.struct(*[F.col(c) for c in previous.columns]).alias("prev"))
    old = F.col("prev.content_hash")
    changed = F.coalesce((old != "") & (old != F.col("content_hash")), F.lit(False))
    return current.join(before, "id", "left").withColumn("change_detected", changed)


def review_state(changes: DataFrame) -> DataFrame:
    """R-06: add ``manual_review``."""

    def asked(kind: Column, reason: str) -> Column:
        return F.struct(
            F.lit(True).alias("required"), F.lit("pending").alias("status"), kind.alias("review_type"),
            F.lit(reason).alias("reason"), F.lit(None).cast("timestamp").alias("reviewed_at"),
            F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("notes"))

    new = F.col("prev").isNull()
    kind = F.when(new, "initial_document_review").otherwise("content_change")
    state = (
        F.when(F.col("validation_status") == "failed", asked(F.lit("failed_download_validation"), REASON_FAILED))
        .when(new | F.col("change_detected"), asked(kind, REASON_NEW))
        .otherwise(F.coalesce(F.col("prev.manual_review").cast(REVIEW),
                              asked(F.lit("metadata_migration_review"), REASON_MIGRATED))))
    return changes.withColumn("manual_review", state)


def carry_forward(changes: DataFrame, now: Column | None = None) -> DataFrame:
    """R-05: curated columns survive only while the content is unchanged."""
    now = F.current_timestamp() if now is None else now
    kept = F.col("prev").isNotNull() & ~F.col("change_detected")
    out = changes
    for name in CURATED:
        out = out.withColumn(name, F.when(kept, F.col(f"prev.{name}")))
    return out.withColumn(
        "currency_status", F.coalesce(F.when(kept, F.col("prev.currency_status")), F.lit("unverified"))
    ).withColumn("downloaded_at", F.coalesce(F.when(kept, F.col("prev.downloaded_at")), now)
    ).withColumn("is_current", F.coalesce("prev.is_current", F.lit(True))).withColumn("last_checked", now)


def eligibility(sources: DataFrame) -> DataFrame:
    """R-07: what may be extracted, and what default retrieval may use."""
    extract = F.coalesce(F.col("validation_status") == "passed", F.lit(False))
    default = (
        extract & F.coalesce("default_retrieval_enabled", F.lit(True)) & ~F.coalesce("is_draft", F.lit(False))
        & F.coalesce(F.col("manual_review.status") == "approved", F.lit(False)))
    return sources.withColumn("eligible_for_extraction", extract).withColumn("eligible_for_default_retrieval", default)


def review_queue(sources: DataFrame) -> DataFrame:
    """R-08."""
    return sources.where(F.col("manual_review.status") == "pending").select(
        F.col("id").alias("document_id"), "manual_review.review_type", "manual_review.reason")


def superseded_sheet(content: Column, first_bytes: int | None = None) -> Column:
    """R-11: over the whole file, or over its first bytes, as the sheet is named on the first page."""
    text = F.decode(F.substring(content, 1, first_bytes) if first_bytes else content, "ISO-8859-1")
    return F.nullif(F.regexp_extract(text, C.SUPERSEDED_SHEET, 1), F.lit(""))


def refresh(current: DataFrame, previous: DataFrame, now: Column | None = None) -> DataFrame:
    """R-04 .. R-09: the next snapshot.

    ``current``: one row per configured source with id, type, content_hash, validation_status,
    default_retrieval_enabled, is_draft, superseded_by_sheet, fetch_error. A source that failed to load keeps
    its old row, marked as changed; without an old row it is dropped.
    """
    fine = current.where(F.col("fetch_error").isNull()).drop("fetch_error")
    new = eligibility(carry_forward(review_state(detect_changes(fine, previous)), now))
    new = new.withColumn("is_draft", F.coalesce("is_draft", "prev.is_draft", F.lit(False))).drop("prev")
    failed = current.where(F.col("fetch_error").isNotNull()).select("id")
    kept = previous.join(failed, "id", "left_semi").withColumn("change_detected", F.lit(True)).withColumn(
        "last_checked", F.current_timestamp() if now is None else now)
    return new.unionByName(kept, allowMissingColumns=True)


def approve(sources: DataFrame, approvals: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """R-10: (updated sources, approvals of unknown ids).

    ``approvals``: id, reviewer, content. Hash, validation and eligibility are taken from the new content.
    """
    now = F.current_timestamp() if now is None else now
    new = approvals.select("id", F.struct("reviewer", "content").alias("a"))
    rows = sources.join(new, "id", "left")
    hit = F.col("a").isNotNull()
    fresh = content_hash(F.col("a.content"))
    status = F.coalesce(signature_status(F.col("type"), F.col("a.content")), F.lit("passed"))
    review = F.struct(
        F.lit(False).alias("required"), F.lit("approved").alias("status"), F.lit("manual_replacement").alias("review_type"),
        F.lit(REASON_REPLACED).alias("reason"), now.cast("timestamp").alias("reviewed_at"),
        F.col("a.reviewer").alias("reviewer"), F.lit(None).cast("string").alias("notes"))
    changed = F.coalesce((F.col("content_hash") != "") & (F.col("content_hash") != fresh), F.lit(False))
    rows = (
        rows.withColumn("change_detected", F.when(hit, changed).otherwise(F.col("change_detected")))
        .withColumn("content_hash", F.when(hit, fresh).otherwise(F.col("content_hash")))
        .withColumn("validation_status", F.when(hit, status).otherwise(F.col("validation_status")))
        .withColumn("manual_review", F.when(hit, review).otherwise(F.col("manual_review").cast(REVIEW))))
    # The rules depend only on the row, so rows without an approval come out as they were.
    out = eligibility(rows).drop("a")
    return out, approvals.join(sources.select("id"), "id", "left_anti").select("id", "reviewer")
