"""Rank fusion, reranking and the five retrieval variants (T-09 .. T-15)."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import text as X
from ..session import materialise
from .fetch import fetched
from .lexical import sent
from .topk import require_between, require_positive, top_k


def literal_rows(df: DataFrame, name: str, values: Sequence, cast: str | None = None) -> DataFrame:
    """Repeat each row for every value of a short list known to the driver."""
    items = F.array(*[F.lit(v) for v in values])
    return df.withColumn(name, F.explode(items.cast(f"array<{cast}>") if cast else items))


def rrf(lexical: DataFrame, vector: DataFrame, alphas: Sequence[float] = (C.HYBRID_ALPHA,), k: int = C.CANDIDATES,
        offset: int = C.RRF_OFFSET) -> DataFrame:
    """T-09: weighted reciprocal rank fusion for all alphas in one pass.

    alpha weighs the lexical side; a missing side adds nothing; both ranks stay.
    """
    require_positive(k=k)
    require_between(0, float("inf"), offset=offset)
    for a in alphas:
        require_between(0.0, 1.0, alpha=a)
    both = lexical.select("query_id", "chunk_id", "lexical_rank").join(
        vector.select("query_id", "chunk_id", "vector_rank"), ["query_id", "chunk_id"], "full_outer")
    rows = literal_rows(both, "alpha", alphas, "double")
    a = F.col("alpha")
    score = F.coalesce(a / (F.col("lexical_rank") + offset), F.lit(0.0)) + F.coalesce(
        (1.0 - a) / (F.col("vector_rank") + offset), F.lit(0.0))
    fused = rows.withColumn("rrf_score", score)
    return top_k(fused, ["query_id", "alpha"], [F.desc("rrf_score"), F.asc("chunk_id")], k, "hybrid_rank")


def overlap_scorer(query: Column, document: Column) -> Column:
    """Default scorer: the share of the query's distinct words that the document holds."""
    asked = F.array_distinct(X.words(query))
    held = F.array_distinct(X.words(document))
    return F.coalesce(F.size(F.array_intersect(asked, held)) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def model_scorer(factory: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], batch: int = 16):
    """A pair model as scorer; it is loaded once per task."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for query, document in batches:
            pairs = list(zip(query, document))
            out: list[float] = []
            for i in range(0, len(pairs), batch):
                out += [float(x) for x in model(pairs[i:i + batch])]
            yield pd.Series(out)

    return score


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, rank: str, scorer=overlap_scorer,
           k: int = C.FINAL_K, limit: int = C.CANDIDATES, characters: int | None = None,
           by: Sequence[str] = ("query_id",)) -> DataFrame:
    """T-10: score the first ``limit`` candidates against the query text, keep the best k.

    Ties keep the order of the first stage. Text joins only the bounded
    candidates. Whole texts are scored, or their
    first ``characters`` (C.RERANK_CHARACTERS is a usual bound).
    """
    require_positive(k=k, limit=limit)
    if characters is not None:
        require_positive(characters=characters)
    first = candidates.where(F.col(rank) <= limit)
    text = F.coalesce("embedding_text", "evidence_text", F.lit("")) if "embedding_text" in chunks.columns else F.coalesce(
        "evidence_text", F.lit(""))
    if characters is not None:
        text = F.substring(text, 1, characters)
    texts = chunks.select("chunk_id", text.alias("__text"))
    rows = first.join(queries.select("query_id", "query_text"), "query_id").join(texts, "chunk_id")
    scored = rows.withColumn("reranker_score", scorer(F.col("query_text"), F.col("__text"))).drop("__text", "query_text")
    return top_k(scored, list(by), [F.desc("reranker_score"), F.asc(rank)], k, "rerank_rank")


def variants(lexical: DataFrame, vector: DataFrame, queries: DataFrame, chunks: DataFrame,
             alphas: Sequence[float] = C.ALPHAS, scorer=overlap_scorer, k: int = C.FINAL_K, limit: int = C.CANDIDATES,
             characters: int | None = None, names: Sequence[str] = C.RETRIEVERS) -> DataFrame:
    """T-11 .. T-13: the named variants over shared candidates: query_id, chunk_id, rank, retriever, alpha.

    The texts of the candidates are fetched once for all reranked variants. Only fused rows depend on alpha; the others carry a null and are fanned out by the grid.
    """
    cols = ["query_id", "chunk_id", "rank", "retriever", "alpha"]
    none = F.lit(None).cast("double")
    hybrid = rrf(lexical, vector, alphas, limit)
    if {"vector_rerank", "hybrid_rerank"} & set(names):
        chunks = fetched(chunks, lexical.where(F.col("lexical_rank") <= limit).select("chunk_id").union(
            vector.where(F.col("vector_rank") <= limit).select("chunk_id")))

    def named(df: DataFrame, rank: str, name: str, alpha: Column = none) -> DataFrame:
        return df.select("query_id", "chunk_id", F.col(rank).alias("rank"), F.lit(name).alias("retriever"), alpha.alias("alpha"))

    build = {
        "lexical": lambda: named(lexical, "lexical_rank", "lexical"),
        "vector": lambda: named(vector, "vector_rank", "vector"),
        "hybrid": lambda: named(hybrid, "hybrid_rank", "hybrid", F.col("alpha")),
        "vector_rerank": lambda: named(
            rerank(vector, queries, chunks, "vector_rank", scorer, k, limit, characters), "rerank_rank", "vector_rerank"),
        "hybrid_rerank": lambda: named(
            rerank(hybrid, queries, chunks, "hybrid_rank", scorer, k, limit, characters, ("query_id", "alpha")),
            "rerank_rank", "hybrid_rerank", F.col("alpha")),
    }
    out = None
    for name in names:
        part = build[name]().select(*cols)
        out = part if out is None else out.unionByName(part)
    return out


def feedback_terms(found: DataFrame, posted: DataFrame, terms: DataFrame, n_terms: int = C.EXPANSION_TERMS, top: int = C.FINAL_K,
                   rank: str = "rank") -> DataFrame:
    """T-15 from the corpus itself: query_id and terms, the words that mark the first ``top`` chunks of each query.

    A word weighs its share of each chunk's words, summed over the chunks, times the logarithm of chunks over chunks that hold
    it; words of the query (``terms``: query_id, lexeme) are left out. Ties go to the smaller word. ``posted``: postings; they are
    read once for the chunks found and once to count, and no query meets the corpus.
    """
    require_positive(n_terms=n_terms, top=top)
    first = found.where(F.col(rank) <= top).select("query_id", "chunk_id")
    counted = posted.select("lexeme", "chunk_id", (F.col("n_a") + F.col("n_b")).alias("tf"))
    first = materialise(first, "feedback-chunks")
    own = materialise(counted.join(sent(first.select("chunk_id").distinct(), "feedback-ids"), "chunk_id", "left_semi"), "feedback-postings")
    corpus = counted.agg(F.count_distinct("chunk_id").alias("chunks"))
    held = counted.join(sent(own.select("lexeme").distinct(), "feedback-words"), "lexeme", "left_semi").groupBy("lexeme").agg(F.count("*").alias("df"))
    lengths = own.groupBy("chunk_id").agg(F.sum("tf").alias("length"))
    shares = first.join(own, "chunk_id").join(lengths, "chunk_id").groupBy("query_id", "lexeme").agg(F.sum(F.col("tf") / F.col("length")).alias("share"))
    shares = shares.join(terms.select("query_id", "lexeme").distinct(), ["query_id", "lexeme"], "left_anti")
    weight = F.round(F.col("share") * F.log(F.col("chunks") / F.col("df")), 10)
    weighted = shares.join(held, "lexeme").join(F.broadcast(corpus)).select("query_id", "lexeme", weight.alias("weight"))  # one row of corpus
    best = top_k(weighted, ["query_id"], [F.desc("weight"), F.asc("lexeme")], n_terms, "place")
    return best.groupBy("query_id").agg(X.ordered_list(F.col("lexeme"), F.col("place")).alias("terms"))


def rewrite_variants(rewrites: DataFrame) -> DataFrame:
    """T-14: one row per non-empty technique: original, hyde, expanded, hyde_expanded."""
    hyde, expanded = F.coalesce("hyde", F.lit("")), F.coalesce("expanded", F.lit(""))
    both = F.when((X.strip(hyde) != "") & (X.strip(expanded) != ""), F.concat(X.strip(hyde), F.lit(" "), X.strip(expanded)))
    pairs = F.array(*[
        F.struct(F.lit(n).alias("technique"), X.strip(c).alias("query_text"))
        for n, c in (("original", F.coalesce("query_text", F.lit(""))), ("hyde", hyde), ("expanded", expanded),
                     ("hyde_expanded", F.coalesce(both, F.lit(""))))])
    rest = [c for c in rewrites.columns if c not in ("query_text", "hyde", "expanded")]
    return rewrites.select(*rest, F.explode(pairs).alias("v")).select(*rest, "v.*").where("query_text != ''")


def expand_queries(queries: DataFrame, n_terms: int = C.EXPANSION_TERMS) -> DataFrame:
    """T-15: question plus exactly ``n_terms`` terms, otherwise the question alone with a status.

    ``queries``: query_id, query_text, terms ARRAY<STRING>, error STRING (from the term source).
    """
    terms = F.filter(F.transform(F.coalesce("terms", F.array().cast("array<string>")), X.strip), lambda t: t != "")
    rows = queries.withColumn("__t", terms)
    good = F.col("error").isNull() & (F.size("__t") == n_terms)
    status = F.when(F.col("error").isNotNull(), "fallback_error").when(good, "expanded").otherwise("fallback_invalid_term_count")
    message = F.when(F.col("error").isNotNull(), F.col("error")).when(
        ~good, F.concat(F.lit(f"Expected {n_terms} terms, got "), F.size("__t").cast("string")))
    return rows.select(
        "query_id", F.col("query_text").alias("original_question"),
        F.when(good, F.col("__t")).otherwise(F.array().cast("array<string>")).alias("expansion_terms"),
        F.when(good, F.concat_ws(" ", "query_text", F.array_join("__t", " "))).otherwise(F.col("query_text")).alias("retrieval_query"),
        status.alias("status"), message.alias("error_message"))
