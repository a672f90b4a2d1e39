"""Evaluation grids, resume, and configuration summaries (V-10 .. V-20)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C
from ..session import materialise
from .fetch import fetched
from .hybrid import literal_rows
from .metrics import Weightings, ranking_metrics, relevance
from .ordered import numbered

REQUIRED = ("query_id", "retriever", "weighting", "ndcg_at_10", "mrr", "recall_at_10")
METRICS = ("ndcg_at_10_mean", "mrr_mean", "recall_at_10_mean", "composite_score")


class InvalidResults(ValueError):
    pass


def retrieval_grid(queries: DataFrame, alphas: Sequence[float] = C.ALPHAS, retrievers: Sequence[str] = C.RETRIEVERS,
                   weightings: Sequence[str] = tuple(C.WEIGHTINGS), rerank_weightings: Sequence[str] = ("equal",),
                   rerank_only: bool = False) -> DataFrame:
    """V-10: query x alpha x retriever x weighting; reranked retrievers take the listed schemes only."""
    names = [r for r in retrievers if r in C.RERANKED or not rerank_only]
    cells = [(r, w) for r in names for w in (rerank_weightings if r in C.RERANKED else weightings)]
    rows = literal_rows(queries.select("query_id"), "alpha", list(alphas), "double")
    cell = F.array(*[F.struct(F.lit(r).alias("retriever"), F.lit(w).alias("weighting")) for r, w in cells])
    return rows.withColumn("c", F.explode(cell)).select("query_id", "alpha", "c.retriever", "c.weighting")


def rewrite_grid(variants: DataFrame, retrievers: Sequence[str] = C.RERANKED, weightings: Sequence[str] = tuple(C.WEIGHTINGS),
                 alpha: float = C.HYBRID_ALPHA) -> DataFrame:
    """V-11: query x technique x retriever x weighting at one alpha; names rewrite_{technique}_{retriever}."""
    cell = F.array(*[F.struct(F.lit(r).alias("retriever"), F.lit(w).alias("weighting")) for r in retrievers for w in weightings])
    rows = variants.select("query_id", "technique", F.explode(cell).alias("c")).select(
        "query_id", "technique", "c.retriever", "c.weighting", F.lit(float(alpha)).alias("alpha"))
    return rows.withColumn("name", F.concat_ws("_", F.lit("rewrite"), "technique", "retriever"))


def evaluate_rewrites(variants: DataFrame, queries: DataFrame, chunks: DataFrame, totals: DataFrame, search, retrievers: Sequence[str] = C.RERANKED,
                      weightings: Weightings = C.WEIGHTINGS, k: int = C.FINAL_K) -> DataFrame:
    """V-11: metrics of every query, technique, retriever and scheme.

    ``variants``: query_id, technique, query_text. ``search`` takes query_id, text_id and query_text and gives text_id, chunk_id, rank
    and retriever. Techniques that give a query the same text share one search, whose lists are measured once and then go to all
    their cells.
    """
    texts = variants.groupBy("query_id", "query_text").agg(F.array_sort(F.collect_list("technique")).alias("techniques"))
    texts = materialise(numbered(texts, ["query_id", "query_text"], "text_id"), "rewritten-texts")
    ranked = materialise(search(texts.select("text_id", "query_id", "query_text")).where(F.col("retriever").isin(*retrievers)), "rewritten-ranked")
    rows = ranked.join(texts.select("text_id", "query_id"), "text_id").select("query_id", "text_id", "chunk_id", "rank", "retriever")
    chunks = fetched(chunks, ranked)
    records = ranking_metrics(relevance(rows, queries, chunks, weightings), totals, ["query_id", "text_id", "retriever", "weighting"], k)
    return records.join(texts.select("text_id", "techniques"), "text_id").withColumn("technique", F.explode("techniques")).drop("techniques")


def pending(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V-12: the cells not evaluated yet; records without all keys do not count."""
    complete = done
    for k in keys:
        complete = complete.where(F.col(k).isNotNull())
    return grid.join(complete.select(*keys).distinct(), list(keys), "left_anti")


def evaluate(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, totals: DataFrame, alphas: Sequence[float] = C.ALPHAS,
             weightings: Weightings = C.WEIGHTINGS, cells: DataFrame | None = None, k: int = C.FINAL_K) -> DataFrame:
    """V-10, V-13: metrics of every ranked list and scheme, one record per alpha.

    Lists that do not depend on alpha are scored once and repeated afterwards.
    ``cells`` restricts the records, for example to the pending ones.
    """
    scored = relevance(ranked, queries, chunks, weightings)
    records = ranking_metrics(scored, totals, ["query_id", "retriever", "alpha", "weighting"], k)
    every = F.array(*[F.lit(float(a)) for a in alphas])
    fixed = records.withColumn("alpha", F.explode(F.when(F.col("alpha").isNull(), every).otherwise(F.array("alpha"))))
    if cells is None:
        return fixed
    return fixed.join(cells, ["query_id", "retriever", "alpha", "weighting"], "left_semi")


def configuration_key(has_technique: bool) -> Column:
    alpha = F.when(F.col("alpha").isNull(), "n/a").otherwise(F.format_string("%.2f", F.col("alpha")))
    parts = [F.concat(F.lit("retriever="), "retriever"), F.concat(F.lit("alpha="), alpha), F.concat(F.lit("weighting="), "weighting")]
    if has_technique:
        parts.insert(0, F.when(F.coalesce("technique", F.lit("")) != "", F.concat(F.lit("technique="), "technique")))
    return F.concat_ws(" | ", *parts)


def check_results(results: DataFrame) -> None:
    """V-16."""
    missing = [c for c in REQUIRED if c not in results.columns]
    if missing:
        raise InvalidResults(f"missing fields: {missing}")
    if results.isEmpty():
        raise InvalidResults("no evaluation records")
    empty = F.lit(False)
    for c in REQUIRED:
        empty = empty | F.col(c).isNull()
    if not results.where(empty).isEmpty():
        raise InvalidResults("records with empty required fields")


def rejected_results(results: DataFrame) -> DataFrame:
    """V-16 as rows: the records that miss required fields, with the names of these; ``check_results`` raises on any."""
    empty = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    return results.withColumn("missing", empty).where(F.size("missing") > 0)


def summarise(results: DataFrame) -> DataFrame:
    """V-15: mean and population deviation per configuration, with the composite score."""
    has_technique = "technique" in results.columns
    rows = results.withColumn("configuration", configuration_key(has_technique))
    technique = F.first("technique") if has_technique else F.lit(None).cast("string")
    out = rows.groupBy("configuration").agg(
        F.first("retriever").alias("retriever"), technique.alias("technique"), F.first("alpha").alias("alpha"),
        F.first("weighting").alias("weighting"), F.count_distinct("query_id").alias("queries_evaluated"),
        F.count("*").alias("records_aggregated"),
        *[f(m).alias(f"{m}_{n}") for m in C.COMPOSITE for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    composite = None
    for metric, w in C.COMPOSITE.items():
        part = F.lit(w) * F.col(f"{metric}_mean")
        composite = part if composite is None else composite + part
    return out.withColumn("composite_score", composite)


def _long(summary: DataFrame) -> DataFrame:
    keep = ["configuration", F.col("ndcg_at_10_mean").alias("by_ndcg"), F.col("mrr_mean").alias("by_mrr")]
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return summary.select(*keep, F.explode(items).alias("m")).select("configuration", "by_ndcg", "by_mrr", "m.*")


def best_by_metric(summary: DataFrame) -> DataFrame:
    """V-17: ties by nDCG, then MRR, then the larger key."""
    best = F.max_by(F.struct("configuration", "value"), F.struct("value", "by_ndcg", "by_mrr", "configuration"))
    return _long(summary).groupBy("metric").agg(best.alias("b")).select("metric", "b.configuration", "b.value")


def recommended(summary: DataFrame) -> DataFrame:
    """V-18: the configuration with the best composite score."""
    best = best_by_metric(summary).where(F.col("metric") == "composite_score").select("configuration")
    cols = ["composite_score", "ndcg_at_10_mean", "mrr_mean", "recall_at_10_mean"]
    return summary.join(best, "configuration", "left_semi").select("configuration", *cols)


def ranked(summary: DataFrame, n: int | None = None, metrics: Sequence[str] = METRICS) -> DataFrame:
    """V-19: configurations per metric; ties by nDCG, then MRR, then the smaller key."""
    order = [F.desc("value"), F.desc("by_ndcg"), F.desc("by_mrr"), F.asc("configuration")]
    rows = _long(summary).where(F.col("metric").isin(*metrics)).withColumn(
        "place", F.row_number().over(Window.partitionBy("metric").orderBy(*order)))
    rows = rows if n is None else rows.where(F.col("place") <= n)
    return rows.select("metric", "place", "configuration", "value")


def run_totals(results: DataFrame) -> DataFrame:
    """V-15, V-20: totals and the distinct retrievers, schemes and alphas."""
    return results.agg(
        F.count("*").alias("total_records"), F.count_distinct("query_id").alias("total_unique_queries"),
        F.array_sort(F.collect_set("retriever")).alias("retrievers_evaluated"),
        F.array_sort(F.collect_set("weighting")).alias("weighting_schemes_evaluated"),
        F.array_sort(F.collect_set("alpha")).alias("alphas_evaluated"))
