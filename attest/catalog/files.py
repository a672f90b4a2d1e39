"""Readers and writers, through files in the shared checkpoint folder."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..session import checkpoint_folder
from ..sources import readers, writers
from . import query
from .common import table


def _place(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/attest/{name}-{uuid.uuid4().hex}"


@query("json_documents", """
select 'w' || page_id document_id, 1 page_number, url as "text" from pages union all select 'w' || page_id, 2, html from pages""")
def json_documents(spark, d):
    """Every page as one JSON file of a document of two pages, read back row by row; a report beside them is left out."""
    place = _place(spark, "json")
    page = lambda n, c: F.struct(F.lit(n).alias("page_number"), F.col(c).alias("text"))
    docs = table(spark, d, "pages").select(F.concat(F.lit("w"), "page_id").alias("document_id"), F.array(page(1, "url"), page(2, "html")).alias("pages"))
    docs.write.option("maxRecordsPerFile", 1).json(place)
    rows = readers.read_json_docs(spark, place, schemas.RAW_PAGES_DOC, ["quality_report.json"], "pages")
    return rows.select("document_id", "page_number", "text")


@query("json_lines", "select 'c' || doc_id chunk_id, text as evidence_text, n_chars::int estimated_evidence_tokens from documents")
def json_lines(spark, d):
    place = _place(spark, "lines")
    table(spark, d, "documents").select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("text").alias("evidence_text"),
                                        F.col("n_chars").cast("int").alias("estimated_evidence_tokens")).write.json(place)
    return readers.read_jsonl(spark, place, schemas.CHUNK).select("chunk_id", "evidence_text", "estimated_evidence_tokens")


@query("embeddings_last_wins", """
select 'v' || vec_id chunk_id, case when vec_id % 3 = 0 then 'second' else 'first' end model_id,
  round(list_sum(embedding::double[]), 4) + case when vec_id % 3 = 0 then 64 else 0 end total from embeddings""")
def embeddings_last_wins(spark, d):
    """Two files of vectors: every third vector is in both, and the later record holds."""
    place = _place(spark, "vectors")
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("chunk_id"), "embedding", "vec_id")
    rows.select("chunk_id", "embedding", F.lit("first").alias("model_id")).write.json(f"{place}/batch=1")
    rows.where("vec_id % 3 = 0").select("chunk_id", F.transform("embedding", lambda x: x + 1).alias("embedding"), F.lit("second").alias("model_id")).write.json(f"{place}/batch=2")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return readers.read_embeddings(spark, place).select("chunk_id", "model_id", F.round(total, 4).alias("total"))


@query("question_files", """
select 'q' || item_id id, text question, case when item_id % 2 = 0 then 1 else 0 end sources, 0 topics from benchmark""")
def question_files(spark, d):
    """Benchmark items as a question file; absent lists read as empty ones."""
    place = _place(spark, "questions")
    table(spark, d, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("id"), F.col("text").alias("question"),
                                        F.when(F.col("item_id") % 2 == 0, F.array(F.lit("s"))).alias("expected_sources")).write.json(place)
    return readers.read_questions(spark, place).select("id", "question", F.size("expected_sources").alias("sources"), F.size("expected_topics").alias("topics"))


@query("appends_and_overwrite", "select doc_id, 'kept' as \"state\" from labels union all select item_id, 'kept' from benchmark")
def appends_and_overwrite(spark, d):
    """Documents are replaced by labels, to which items are appended."""
    place = _place(spark, "appends")
    writers.append(table(spark, d, "documents").select("doc_id", F.lit("gone").alias("state")), place)
    writers.overwrite(table(spark, d, "labels").select("doc_id", F.lit("kept").alias("state")), place)
    writers.append(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("kept").alias("state")), place)
    return spark.read.parquet(place)


@query("upsert_refresh", """
select doc_id, max(version) version, bool_or(new) refreshed from (
  select doc_id, 0 version, false new from documents union all select doc_id, 1 + quality, true from labels) group by 1""")
def upsert_refresh(spark, d):
    """Labels come twice for every document, in two versions; the last one holds and is stamped."""
    base = table(spark, d, "documents").select("doc_id", F.lit(0).alias("version"), F.lit(None).cast("timestamp").alias("updated_at"))
    one = table(spark, d, "labels").select("doc_id", F.lit(0).alias("version"), F.lit(None).cast("timestamp").alias("updated_at"))
    two = table(spark, d, "labels").select("doc_id", (1 + F.col("quality")).cast("int").alias("version"), F.lit(None).cast("timestamp").alias("updated_at"))
    out = writers.upsert(base, one.union(two), ["doc_id"], refresh="updated_at", order="version")
    return out.select("doc_id", "version", F.col("updated_at").isNotNull().alias("refreshed"))
