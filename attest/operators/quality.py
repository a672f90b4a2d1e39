"""Quality gates over blocks and chunks (Q-01 .. Q-06, C-14)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .ordered import SEGMENT, dedup_adjacent, scan, segment_of

SHORT_BELOW, OVERSIZED_ABOVE = 5, 1200
ROWS_PER_SEGMENT = 8192


class GateFailed(RuntimeError):
    pass


def _violations(df: DataFrame, document: str, subject: Column, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[
        F.when(hit, F.struct(F.lit(severity).alias("severity"), F.concat(subject, F.lit(": "), message).alias("message")))
        for severity, hit, message in rules
    ]))
    return df.select(F.col(document).alias("document_id"), F.explode(found).alias("v")).select(
        "document_id", "v.severity", "v.message")


def _missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def check_blocks(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Q-01, Q-02: one row per violation. ``documents``: document_id, source_type, schema_version, content_hash."""
    rows = blocks.join(documents.select("document_id", "source_type"), "document_id", "left")
    counts = F.coalesce("is_substantive", F.lit(True))
    no_path = F.coalesce(F.size("heading_path"), F.lit(0)) <= 0
    no_cited_path = F.coalesce(F.size("citation.heading_path"), F.lit(0)) <= 0
    block_rules = [
        ("error", _missing(F.col("source_id")), F.lit("missing source_id")),
        ("error", _missing(F.col("text")), F.lit("empty text")),
        ("warning", counts & no_path, F.lit("no heading path")),
        ("error", (F.col("source_type") == "pdf") & counts & F.col("citation.pdf_page_start").isNull(),
         F.lit("PDF block missing pdf_page_start")),
        ("error", (F.col("source_type") == "html") & counts & no_cited_path,
         F.lit("HTML block missing heading-path citation")),
    ]
    document_rules = [
        ("error", _missing(F.col("schema_version")), F.lit("missing schema_version")),
        ("warning", _missing(F.col("content_hash")), F.lit("missing source content hash")),
    ]
    return _violations(rows, "document_id", F.col("block_id"), block_rules).unionByName(
        _violations(documents, "document_id", F.lit("document"), document_rules))


def block_type_counts(blocks: DataFrame) -> DataFrame:
    """Q-03: counters as sorted maps per document."""
    types = blocks.groupBy("document_id", F.coalesce("block_type", F.lit("unknown")).alias("k")).count()
    flags = blocks.select("document_id", F.explode("normalisation_flags").alias("k")).groupBy("document_id", "k").count()
    return counter_map(types, "block_types").join(counter_map(flags, "normalisation_flags"), "document_id", "full_outer")


def counter_map(counts: DataFrame, name: str, by: str = "document_id") -> DataFrame:
    entry = F.struct("k", F.col("count").alias("v"))
    return counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))


def block_counters(blocks: DataFrame, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Q-04: short, oversized and adjacent duplicate blocks per document."""
    rows = blocks.select(
        "document_id", "ordinal", "block_type", "heading_path", F.xxhash64("text").alias("text_hash"),
        F.coalesce("is_substantive", F.lit(True)).alias("counts"), X.word_count(F.col("text")).alias("n_words"),
        segment_of(F.col("ordinal"), rows_per_segment).alias(SEGMENT))
    marked = dedup_adjacent(rows, ["document_id"], SEGMENT, ["ordinal"], ["block_type", "text_hash", "heading_path"])
    return marked.groupBy("document_id").agg(
        F.count("*").alias("block_count"),
        F.count_if(F.col("counts") & F.col("n_words").between(1, SHORT_BELOW - 1)).alias("short_substantive_blocks"),
        F.count_if(F.col("n_words") > OVERSIZED_ABOVE).alias("oversized_blocks"),
        F.count_if(F.col("is_repeat")).alias("adjacent_duplicate_blocks"))


def document_status(violations: DataFrame, documents: DataFrame) -> DataFrame:
    """Q-05: errors fail, warnings call for review."""
    counts = violations.groupBy("document_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = documents.select("document_id").join(counts, "document_id", "left").na.fill(0)
    status = F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "review").otherwise("pass")
    return out.withColumn("status", status)


def corpus_report(status: DataFrame) -> DataFrame:
    """Q-06: one row of totals."""
    return status.agg(
        F.count("*").alias("documents"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "review", "fail")])


def gate(status: DataFrame) -> DataFrame:
    """Q-06: raise when a document fails, otherwise pass the table on."""
    report = corpus_report(status).first()
    if report["documents"] == 0:
        raise GateFailed("no documents to check")
    if report["fail"]:
        raise GateFailed(f"{report['fail']} of {report['documents']} documents failed")
    return status


def check_chunks(chunks: DataFrame, documents: DataFrame, hard: int = 750,
                 rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """C-14. ``documents``: document_id, source_id."""
    rows = chunks.select(
        "document_id", "chunk_id", "chunk_ordinal", "source_id", "previous_chunk_id", "next_chunk_id",
        _missing(F.col("evidence_text")).alias("no_evidence"), _missing(F.col("embedding_text")).alias("no_embedding"),
        (F.coalesce(F.size("block_ids"), F.lit(0)) <= 0).alias("no_blocks"),
        F.col("citation").isNull().alias("no_citation"),
        (F.coalesce("estimated_evidence_tokens", F.lit(0)) > hard).alias("over"),
        segment_of(F.col("chunk_ordinal"), rows_per_segment).alias(SEGMENT))
    linked = scan(rows, ["document_id"], SEGMENT, ["chunk_ordinal"],
                  lags={"before": F.col("chunk_id")}, leads={"after": F.col("chunk_id")})
    owner = documents.select("document_id", F.col("source_id").alias("document_source"))
    linked = linked.join(owner, "document_id", "left")
    bad_previous = F.col("before").isNotNull() & ~F.col("before.v").eqNullSafe(F.col("previous_chunk_id"))
    bad_next = F.col("after").isNotNull() & ~F.col("after.v").eqNullSafe(F.col("next_chunk_id"))
    rules = [
        ("error", F.col("no_evidence"), F.lit("empty evidence_text")),
        ("error", F.col("no_embedding"), F.lit("empty embedding_text")),
        ("error", F.col("no_blocks"), F.lit("no block_ids")),
        ("error", ~F.col("source_id").eqNullSafe(F.col("document_source")),
         F.lit("source_id does not match document source")),
        ("error", F.col("no_citation"), F.lit("missing citation")),
        ("warning", F.col("over"), F.lit("exceeds hard token target")),
        ("error", bad_previous, F.lit("invalid previous_chunk_id")),
        ("error", bad_next, F.lit("invalid next_chunk_id")),
    ]
    return _violations(linked, "document_id", F.col("chunk_id"), rules)


def chunk_flags(chunks: DataFrame) -> DataFrame:
    flags = chunks.select("document_id", F.explode("chunking_flags").alias("k")).groupBy("document_id", "k").count()
    return counter_map(flags, "flags")
