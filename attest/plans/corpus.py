"""The corpus build as one composition: pages or HTML to chunks, with its gates."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..operators import chunk, html, normalise, quality
from ..session import materialise
from ..sources.writers import ledger


def blocks_of_pages(pages: DataFrame, rules: normalise.Rules, default: C.PageRules = C.PageRules()) -> DataFrame:
    return materialise(normalise.normalise_pages(pages, rules, default), "blocks")


def blocks_of_html(pages: DataFrame, sources: DataFrame, rules=None) -> DataFrame:
    """``pages``: page_id, url, html. ``sources``: page_id, document_id, source_id, source_hash."""
    raw = html.html_blocks(pages).join(sources, "page_id")
    return materialise(normalise.normalise_html(raw, rules or {}), "blocks")


def build_chunks(blocks: DataFrame, documents: DataFrame, policies: DataFrame, limits: C.ChunkLimits = C.ChunkLimits()) -> tuple[DataFrame, DataFrame]:
    """Gate the blocks, chunk them, gate the chunks: (chunks, ledger).

    ``documents``: document_id, source_id, source_type, schema_version, content_hash, title.
    """
    quality.gate(quality.document_status(quality.check_blocks(blocks, documents), documents))
    made = materialise(chunk.chunks(blocks, policies, documents, limits), "chunks")
    known = documents.join(policies.select("source_id"), "source_id", "left_semi")
    quality.gate(quality.document_status(quality.check_chunks(made, documents, limits.hard), known))
    counts = made.groupBy("document_id").agg(F.count("*").alias("count"))
    return made, ledger("chunk", ok=counts, failed=chunk.missing_policy(blocks, policies))
