"""A batch of questions to checked answers: cache, retrieval, evidence, generation, validation."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..operators import embed, evidence, hybrid, monitor, vector_search
from ..operators.fetch import fetched
from ..operators.topk import split_blank
from ..session import materialise
from ..sources.writers import upsert


def vector_reranked(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, scorer=hybrid.overlap_scorer, k: int = C.FINAL_K,
                    limit: int = C.CANDIDATES, characters: int | None = None) -> DataFrame:
    """T-11. ``queries``: query_id, query_text, embedding."""
    near = materialise(vector_search.vector_topk(queries, vectors, limit), "near")
    return hybrid.rerank(near, queries, fetched(chunks, near), "vector_rank", scorer, k, limit, characters)


def hybrid_reranked(queries: DataFrame, lexical: DataFrame, vectors: DataFrame, chunks: DataFrame, scorer=hybrid.overlap_scorer,
                    alpha: float = C.HYBRID_ALPHA, k: int = C.FINAL_K, limit: int = C.CANDIDATES,
                    characters: int | None = None) -> DataFrame:
    """T-12."""
    fused = materialise(hybrid.rrf(lexical, vector_search.vector_topk(queries, vectors, limit), (alpha,), limit), "fused")
    return hybrid.rerank(fused, queries, fetched(chunks, fused), "hybrid_rank", scorer, k, limit, characters)


def answer_batch(questions: DataFrame, cache: DataFrame, vectors: DataFrame, chunks: DataFrame, embedder, generator=None,
                 prompt_version: str = "v3_few_shot_grounded_rag", k: int = C.FINAL_K, characters: int | None = None,
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cached answers, new answers, rejected blank questions). ``questions``: query_id, query_text.

    Only questions that the cache does not hold are retrieved for and answered.
    """
    usable, rejected = split_blank(questions, "query_text")
    keyed = usable.withColumn("question_text", F.col("query_text")).withColumn(
        "config_hash", monitor.config_hash(F.lit(prompt_version), F.lit(k), F.lit("default")))
    hits, misses = monitor.cache_split(keyed, cache)
    vectored, _ = embed.embed_queries(misses, embedder)
    near = materialise(vector_search.vector_topk(vectored, vectors, C.CANDIDATES), "near")
    texts = fetched(chunks, near)  # one pass over the corpus for reranking and evidence
    final = hybrid.rerank(near, vectored, texts, "vector_rank", k=k, characters=characters)
    packs = evidence.evidence_pack(final, texts, "rerank_rank", "reranker_score")
    prompted = evidence.prompts(misses, packs)
    return hits, evidence.fail_closed(evidence.validate_citations(evidence.generate(prompted, generator))), rejected


def remember(cache: DataFrame, answered: DataFrame) -> DataFrame:
    """S-08: the cache with the new answers; known entries keep their id."""
    key = F.sha2(F.concat_ws("|", "question_text", "config_hash"), 256)
    new = answered.select(key.alias("cache_id"), "question_text", "config_hash", F.current_timestamp().alias("created_at"),
                          F.col("displayed_answer.answer_status").alias("answer_status"), "displayed_answer", "evidence_snapshot")
    return upsert(cache, new.select(*cache.columns), ["question_text", "config_hash"], keep=["cache_id"])
