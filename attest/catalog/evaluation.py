"""Benchmark records, relevance, ranking metrics, grids and configuration summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import grid, hybrid, lexical, metrics, topk, vector_search
from ..operators.fetch import fetched
from ..session import materialise
from . import query
from .common import CHUNKS_SQL, benchmark_queries, document_chunks, document_postings, gold_queries, once, query_vectors, table, vector_table
from .retrieval import ALPHAS, POSTINGS_SQL, TF_SQL, VARIANTS_SQL, _vector_sql, fused_sql, rerank_sql, terms_sql, variant_rows

SCHEMES_SQL = "schemes(weighting, w1, w2, w3, w4, w5) as (values " + ", ".join(
    "('{}', {})".format(n, ", ".join(f"{w[f]}::double" for f in C.FEATURES)) for n, w in C.WEIGHTINGS.items()) + ")"
GOLD_SQL = """
gold as (select item_id query_id, source_id g_source, sections g_sections, page g_page, types g_types, tier g_tier
  from benchmark join docs on chunk_id = item_id)
"""
SCORE = """w1 * (source_id = g_source)::int::double + w2 * list_has_any(sections, g_sections)::int::double
  + w3 * (abs(page - g_page) <= 2)::int::double + w4 * list_has_any(types, g_types)::int::double + w5 * (tier = g_tier)::int::double"""
RELEVANCE_SQL = f"""{VARIANTS_SQL}, {GOLD_SQL}, {SCHEMES_SQL},
scored as (
  select v.*, weighting, {SCORE} score from variants v join docs d on d.chunk_id = v.chunk_id
  join gold g on g.query_id = v.query_id, schemes),
totals as (
  select query_id, weighting, count(*) filter ({SCORE} > 0.5) total_relevant from gold, docs, schemes group by all)
"""
METRICS_SQL = RELEVANCE_SQL + f""",
bested as (
  select *, row_number() over (partition by query_id, retriever, alpha, weighting order by score desc, "rank") best from scored),
lists as (
  select query_id, retriever, alpha, weighting, sum(case when "rank" <= 10 then score / log2("rank" + 1) else 0 end) dcg,
    sum(case when best <= 10 then score / log2(best + 1) else 0 end) idcg, min("rank") filter (score > 0.5) first_relevant,
    count(*) filter (score > 0.5 and "rank" <= 10) found, count(*) retrieved_count
  from bested group by all),
measured as (
  select l.*, coalesce(dcg / nullif(idcg, 0), 0) ndcg_at_10, coalesce(1.0::double / first_relevant, 0) mrr,
    case when total_relevant > 0 then found / total_relevant::double else 0 end recall_at_10, total_relevant
  from lists l join totals t on t.query_id = l.query_id and t.weighting = l.weighting),
results as (
  select m.query_id, retriever, a.alpha, weighting, ndcg_at_10, mrr, recall_at_10, total_relevant, retrieved_count
  from measured m join (values {', '.join(f'({a}::double)' for a in ALPHAS)}) a(alpha) on m.alpha is null or m.alpha = a.alpha)
"""
SUMMARY_SQL = METRICS_SQL + """,
summary as (
  select *, 0.5::double * ndcg_at_10_mean + 0.3::double * mrr_mean + 0.2::double * recall_at_10_mean composite_score from (
    select 'retriever=' || retriever || ' | alpha=' || printf('%.2f', alpha) || ' | weighting=' || weighting configuration,
      count(distinct query_id) queries_evaluated, count(*) records_aggregated,
      avg(ndcg_at_10) ndcg_at_10_mean, stddev_pop(ndcg_at_10) ndcg_at_10_std, avg(mrr) mrr_mean, stddev_pop(mrr) mrr_std,
      avg(recall_at_10) recall_at_10_mean, stddev_pop(recall_at_10) recall_at_10_std
    from results group by 1))
"""
# Means are compared at nine decimals, so that the order of summation does not decide a tie.
ROUNDED_SQL = SUMMARY_SQL + """,
r as (select configuration, round(ndcg_at_10_mean, 9) ndcg_at_10_mean, round(mrr_mean, 9) mrr_mean,
  round(recall_at_10_mean, 9) recall_at_10_mean, round(composite_score, 9) composite_score from summary),
long as (
  unpivot (select configuration, ndcg_at_10_mean n, mrr_mean m, ndcg_at_10_mean, mrr_mean, recall_at_10_mean, composite_score from r)
  on ndcg_at_10_mean, mrr_mean, recall_at_10_mean, composite_score into name metric value "value")
"""


@once
def totals(spark, d):
    return materialise(metrics.corpus_relevant(gold_queries(spark, d), document_chunks(spark, d)), "relevant")


@once
def results(spark, d):
    """All records, evaluated once into a table that summaries, rankings and totals read."""
    ranked = variant_rows(spark, d)
    chunks = fetched(document_chunks(spark, d).drop("evidence_text"), ranked)
    out = grid.evaluate(ranked, gold_queries(spark, d), chunks, totals(spark, d), ALPHAS)
    return materialise(out, "evaluated")


def summary(spark, d):
    rows = grid.summarise(results(spark, d))
    measures = [c for c in rows.columns if c.endswith(("_mean", "_std", "_score"))]
    return rows.select(*[F.round(c, 9).alias(c) if c in measures else F.col(c) for c in rows.columns])


@query("stratified_sample", """
select chunk_id, source_id from (
  select doc_id chunk_id, source source_id, row_number() over (partition by source order by sha256('42' || doc_id), doc_id) n from documents)
where n <= 5""")
def stratified_sample(spark, d):
    return metrics.stratified_sample(document_chunks(spark, d).select("chunk_id", "source_id"), 5)


@query("benchmark_records", f"""with {CHUNKS_SQL}
select 'q' || sha256(item_id || text)[1:8] query_id, text query_text, item_id gold_chunk_id, source_id gold_source, sha256(evidence_text) evidence
from benchmark join docs on chunk_id = item_id""")
def benchmark_records(spark, d):
    questions = benchmark_queries(spark, d).select(
        F.col("query_id").alias("chunk_id"), "query_text", F.lit("broad_research").alias("query_type"))
    out = metrics.benchmark_records(questions, document_chunks(spark, d), characters=None)
    return out.select("query_id", "query_text", "gold_chunk_id", F.col("gold_metadata.source_id").alias("gold_source"),
                      F.sha2("evidence", 256).alias("evidence"))


@query("benchmark_records_cut", f"""with {CHUNKS_SQL}
select 'q' || sha256(item_id || text)[1:8] query_id, text query_text, item_id gold_chunk_id, source_id gold_source, sha256(evidence_text[1:800]) evidence
from benchmark join docs on chunk_id = item_id""")
def benchmark_records_cut(spark, d):
    """The same with the first 800 characters of the evidence."""
    questions = benchmark_queries(spark, d).select(
        F.col("query_id").alias("chunk_id"), "query_text", F.lit("broad_research").alias("query_type"))
    out = metrics.benchmark_records(questions, document_chunks(spark, d), characters=800)
    return out.select("query_id", "query_text", "gold_chunk_id", F.col("gold_metadata.source_id").alias("gold_source"),
                      F.sha2("evidence", 256).alias("evidence"))


@query("source_descriptions", """
select doc_id, case when source like '%1%' then 'first shelf' when source like '%2%' then 'second shelf' else 'other shelf' end description
from documents""")
def source_descriptions(spark, d):
    text = metrics.source_description(F.col("source"), (("1", "first shelf"), ("2", "second shelf")), "other shelf")
    return table(spark, d, "documents").select("doc_id", text.alias("description"))


@query("metadata_relevance", f'with {RELEVANCE_SQL} select query_id, chunk_id, "rank"::int as "rank", retriever, alpha, weighting, round(score, 9) score, score > 0.5 relevant from scored')
def metadata_relevance(spark, d):
    ranked = variant_rows(spark, d)
    chunks = fetched(document_chunks(spark, d).drop("evidence_text"), ranked)
    out = metrics.relevance(ranked, gold_queries(spark, d), chunks)
    return out.withColumn("score", F.round("score", 9))


@query("corpus_relevant", f"""with {CHUNKS_SQL}, {GOLD_SQL}, {SCHEMES_SQL}
select query_id, weighting, count(*) filter ({SCORE} > 0.5) total_relevant from gold, docs, schemes group by all""")
def corpus_relevant(spark, d):
    return totals(spark, d)


@query("ndcg_mrr_recall", f"""with {METRICS_SQL}
select query_id, retriever, alpha, weighting, round(ndcg_at_10, 8) ndcg_at_10, round(mrr, 8) mrr, round(recall_at_10, 8) recall_at_10,
  total_relevant, retrieved_count from results""")
def ndcg_mrr_recall(spark, d):
    out = results(spark, d)
    return out.select("query_id", "retriever", "alpha", "weighting", *[F.round(c, 8).alias(c) for c in ("ndcg_at_10", "mrr", "recall_at_10")],
                      "total_relevant", "retrieved_count")


def _grid_sql(where: str) -> str:
    return f"""
select item_id query_id, alpha, retriever, weighting from benchmark, (values {', '.join(f'({a}::double)' for a in ALPHAS)}) a(alpha),
  (values {', '.join(f"('{r}')" for r in C.RETRIEVERS)}) r(retriever), (values {', '.join(f"('{w}')" for w in C.WEIGHTINGS)}) w(weighting)
where (retriever not like '%rerank' or weighting = 'equal') and {where}"""


@query("evaluation_grid", _grid_sql("true"))
def evaluation_grid(spark, d):
    return grid.retrieval_grid(benchmark_queries(spark, d), ALPHAS)


@query("eval_resume_pending", _grid_sql("not (item_id % 4 <> 0 and retriever in ('lexical', 'vector'))"))
def eval_resume_pending(spark, d):
    cells = grid.retrieval_grid(benchmark_queries(spark, d), ALPHAS)
    done = cells.where((F.col("query_id") % 4 != 0) & F.col("retriever").isin("lexical", "vector"))
    return grid.pending(cells, done, ["query_id", "alpha", "retriever", "weighting"])


@query("rewrite_grid", """
select item_id query_id, technique, retriever, weighting, 0.5::double alpha, 'rewrite_' || technique || '_' || retriever as "name"
from benchmark, (values ('original'), ('hyde'), ('expanded'), ('hyde_expanded')) t(technique), (values ('vector_rerank'), ('hybrid_rerank')) r(retriever),
  (values ('equal'), ('source_heavy'), ('section_heavy'), ('page_heavy'), ('authority_heavy')) w(weighting)
where (technique in ('original', 'expanded') or item_id % 2 = 0) and (technique in ('original', 'hyde') or item_id % 3 <> 0)""")
def rewrite_grid(spark, d):
    from ..operators.hybrid import rewrite_variants

    n = F.col("query_id")
    rows = benchmark_queries(spark, d).withColumn("hyde", F.when(n % 2 == 0, F.concat(F.lit("a passage on "), "query_text"))).withColumn(
        "expanded", F.when(n % 3 != 0, F.concat_ws(" ", "query_text", F.lit("more terms"))))
    return grid.rewrite_grid(rewrite_variants(rows))


@query("rewrite_texts", """
with v as (select item_id query_id, text, case when item_id % 2 = 0 then 'a passage on ' || text end hyde, case when item_id % 3 <> 0 then text || ' more terms' end expanded from benchmark)
select query_id, technique, q query_text from (
  select query_id, 'original' technique, text q from v union all select query_id, 'hyde', hyde from v union all select query_id, 'expanded', expanded from v
  union all select query_id, 'hyde_expanded', hyde || ' ' || expanded from v) where q is not null""")
def rewrite_texts(spark, d):
    """The texts that the four techniques are retrieved with."""
    from ..operators.hybrid import rewrite_variants

    n = F.col("query_id")
    rows = benchmark_queries(spark, d).select("query_id", "query_text").withColumn("hyde", F.when(n % 2 == 0, F.concat(F.lit("a passage on "), "query_text"))).withColumn(
        "expanded", F.when(n % 3 != 0, F.concat_ws(" ", "query_text", F.lit("more terms"))))
    return rewrite_variants(rows).select("query_id", "technique", "query_text")


@query("config_summary", f"""with {SUMMARY_SQL}
select configuration, queries_evaluated, records_aggregated, {', '.join(
    f'round({m}_{s}, 6) {m}_{s}' for m in ('ndcg_at_10', 'mrr', 'recall_at_10') for s in ('mean', 'std'))},
  round(composite_score, 6) composite_score from summary""")
def config_summary(spark, d):
    rows = summary(spark, d)
    keep = [c for c in rows.columns if c.endswith(("_mean", "_std", "_score"))]
    return rows.select("configuration", "queries_evaluated", "records_aggregated", *[F.round(c, 6).alias(c) for c in keep])


@query("best_by_metric", f"""with {ROUNDED_SQL}
select metric, arg_max(configuration, (value, n, m, configuration)) configuration, round(max(value), 6) as "value" from long group by 1""")
def best_by_metric(spark, d):
    return grid.best_by_metric(summary(spark, d)).withColumn("value", F.round("value", 6))


@query("recommended_configuration", f"""with {ROUNDED_SQL}
select configuration, round(composite_score, 6) composite_score, round(ndcg_at_10_mean, 6) ndcg_at_10_mean, round(mrr_mean, 6) mrr_mean,
  round(recall_at_10_mean, 6) recall_at_10_mean
from r order by r.composite_score desc, r.ndcg_at_10_mean desc, r.mrr_mean desc, configuration desc limit 1""")
def recommended_configuration(spark, d):
    out = grid.recommended(summary(spark, d))
    return out.select("configuration", *[F.round(c, 6).alias(c) for c in out.columns if c != "configuration"])


@query("ranked_configurations", f"""with {ROUNDED_SQL}
select metric, place::int place, configuration, round(value, 6) as "value" from (
  select *, row_number() over (partition by metric order by value desc, n desc, m desc, configuration) place from long)
where place <= 10""")
def ranked_configurations(spark, d):
    return grid.ranked(summary(spark, d), 10).withColumn("value", F.round("value", 6))


@query("run_totals", f"""with {METRICS_SQL}
select count(*) total_records, count(distinct query_id) total_unique_queries,
  array_to_string(list_sort(list(distinct retriever)), ',') retrievers, array_to_string(list_sort(list(distinct weighting)), ',') weightings,
  len(list(distinct alpha))::int n_alphas from results""")
def run_totals(spark, d):
    out = grid.run_totals(results(spark, d))
    return out.select(
        "total_records", "total_unique_queries", F.array_join("retrievers_evaluated", ",").alias("retrievers"),
        F.array_join("weighting_schemes_evaluated", ",").alias("weightings"), F.size("alphas_evaluated").alias("n_alphas"))


# --- rewrites ---------------------------------------------------------------------------------

REWRITES = """
rewrites as (
  select item_id query_id, trim(text) query_text, case when item_id % 2 = 0 then 'Released under the MIT License' when item_id % 7 = 0 then trim(text) end hyde,
    case when item_id % 3 <> 0 then trim(text) || ' the of and' end expanded from benchmark),
rewritten as (
  select query_id, 'original' technique, query_text from rewrites union all select query_id, 'hyde', hyde from rewrites where hyde is not null
  union all select query_id, 'expanded', expanded from rewrites where expanded is not null
  union all select query_id, 'hyde_expanded', hyde || ' ' || expanded from rewrites where hyde is not null and expanded is not null),
texts as (select *, row_number() over (order by query_id, query_text) - 1 text_id from (select distinct query_id, query_text from rewritten))"""
REWRITTEN_SQL = f"""{POSTINGS_SQL}, {REWRITES},
{terms_sql('select text_id query_id, query_text from texts').lstrip()}, {TF_SQL.format(k=50)},
{_vector_sql('select t.text_id query_id, embedding::double[] q from texts t join embeddings on vec_id = t.query_id', 50)},
{fused_sql((0.5,))},
{rerank_sql('vector_reranked', 'vector_ranked', 'vector_rank')},
{rerank_sql('hybrid_reranked', 'hybrid_ranked', 'hybrid_rank')},
{GOLD_SQL}, {SCHEMES_SQL},
ranked as (
  select query_id text_id, chunk_id, rerank_rank "rank", 'vector_rerank' retriever from vector_reranked
  union all select query_id, chunk_id, rerank_rank, 'hybrid_rerank' from hybrid_reranked),
scored as (
  select r.*, t.query_id, weighting, {SCORE} score from ranked r join texts t on t.text_id = r.text_id join docs d on d.chunk_id = r.chunk_id
  join gold g on g.query_id = t.query_id, schemes),
totals as (
  select query_id, weighting, count(*) filter ({SCORE} > 0.5) total_relevant from gold, docs, schemes group by all),
bested as (select *, row_number() over (partition by text_id, retriever, weighting order by score desc, "rank") best from scored),
lists as (
  select query_id, text_id, retriever, weighting, sum(case when "rank" <= 10 then score / log2("rank" + 1) else 0 end) dcg,
    sum(case when best <= 10 then score / log2(best + 1) else 0 end) idcg, min("rank") filter (score > 0.5) first_relevant,
    count(*) filter (score > 0.5 and "rank" <= 10) found from bested group by all),
results as (
  select w.technique, l.query_id, l.retriever, l.weighting, coalesce(dcg / nullif(idcg, 0), 0) ndcg_at_10, coalesce(1.0::double / first_relevant, 0) mrr,
    case when total_relevant > 0 then found / total_relevant::double else 0 end recall_at_10
  from lists l join totals using (query_id, weighting) join texts t on t.text_id = l.text_id
  join rewritten w on w.query_id = t.query_id and w.query_text = t.query_text)"""


@once
def rewritten_results(spark, d):
    """Every technique, retriever and scheme; a text that several techniques give is searched and measured once."""
    n, text = F.col("query_id"), F.trim("query_text")
    rows = benchmark_queries(spark, d).select("query_id", text.alias("query_text")) \
        .withColumn("hyde", F.when(n % 2 == 0, "Released under the MIT License").when(n % 7 == 0, F.col("query_text"))) \
        .withColumn("expanded", F.when(n % 3 != 0, F.concat("query_text", F.lit(" the of and"))))
    chunks, vectors = document_chunks(spark, d), vector_table(spark, d)

    def search(texts):
        keyed = texts.select(F.col("text_id").alias("query_id"), "query_text")
        found = materialise(lexical.lexical_topk(keyed, document_postings(spark, d), 50, "tf_weighted", stemmed=False), "lexical")
        asked = texts.join(query_vectors(spark, d), "query_id").select(F.col("text_id").alias("query_id"), "embedding")
        near = materialise(vector_search.vector_topk(asked, vectors, 50), "near")
        out = hybrid.variants(found, near, keyed, chunks, (C.HYBRID_ALPHA,), characters=None, names=C.RERANKED)
        return out.withColumnRenamed("query_id", "text_id")

    out = grid.evaluate_rewrites(hybrid.rewrite_variants(rows), gold_queries(spark, d), chunks.drop("evidence_text"), totals(spark, d), search)
    return materialise(out.withColumn("alpha", F.lit(C.HYBRID_ALPHA)), "rewritten")


@query("rewrite_results", f"""with {REWRITTEN_SQL}
select query_id, technique, retriever, weighting, round(ndcg_at_10, 8) ndcg_at_10, round(mrr, 8) mrr, round(recall_at_10, 8) recall_at_10 from results""")
def rewrite_results(spark, d):
    return rewritten_results(spark, d).select("query_id", "technique", "retriever", "weighting",
                                              *[F.round(c, 8).alias(c) for c in ("ndcg_at_10", "mrr", "recall_at_10")])


@query("rewrite_summary", f"""with {REWRITTEN_SQL}
select 'technique=' || technique || ' | retriever=' || retriever || ' | alpha=0.50 | weighting=' || weighting configuration, technique,
  count(distinct query_id) queries_evaluated, round(avg(ndcg_at_10), 6) ndcg_at_10_mean, round(avg(mrr), 6) mrr_mean, round(avg(recall_at_10), 6) recall_at_10_mean,
  round(0.5::double * avg(ndcg_at_10) + 0.3::double * avg(mrr) + 0.2::double * avg(recall_at_10), 6) composite_score
from results group by retriever, weighting, technique""")
def rewrite_summary(spark, d):
    """Configurations by technique."""
    out = grid.summarise(rewritten_results(spark, d))
    means = ("ndcg_at_10_mean", "mrr_mean", "recall_at_10_mean", "composite_score")
    return out.select("configuration", "technique", "queries_evaluated", *[F.round(c, 6).alias(c) for c in means])


# --- rejects ----------------------------------------------------------------------------------

_REQUIRED = ", ".join(f"case when {c} is null then '{c}' end" for c in grid.REQUIRED)


@query("rejected_results", f"""with {METRICS_SQL},
holes as (
  select query_id, case when query_id % 3 = 0 and retriever = 'vector' then null else retriever end retriever, alpha, weighting,
    case when query_id % 5 = 0 and weighting = 'equal' then null else ndcg_at_10 end ndcg_at_10, case when query_id % 7 = 0 and weighting = 'equal' then null else mrr end mrr, recall_at_10
  from results)
select query_id, alpha, weighting, array_to_string(list_filter([{_REQUIRED}], lambda x: x is not null), ',') missing, count(*) n
from holes where query_id is null or retriever is null or weighting is null or ndcg_at_10 is null or mrr is null or recall_at_10 is null group by all""")
def rejected_results(spark, d):
    """All records with holes by query: those that a summary may not be made of."""
    q, w = F.col("query_id"), F.col("weighting") == "equal"
    rows = results(spark, d).withColumns({
        "retriever": F.when(~((q % 3 == 0) & (F.col("retriever") == "vector")), F.col("retriever")), "ndcg_at_10": F.when(~((q % 5 == 0) & w), F.col("ndcg_at_10")),
        "mrr": F.when(~((q % 7 == 0) & w), F.col("mrr"))})
    return grid.rejected_results(rows).groupBy("query_id", "alpha", "weighting", F.array_join("missing", ",").alias("missing")).agg(F.count("*").alias("n"))


_WEIGHT = {f: f"case when c_custkey % 7 = {i} then null else (c_custkey * {i + 1} % 5) / 10.0::double end" for i, f in enumerate(C.FEATURES)}


@query("weighting_rejects", f"""
with w as (select c_custkey weighting, {', '.join(f'{sql} as "{f}"' for f, sql in _WEIGHT.items())} from customer),
r as (select weighting, list_filter([{', '.join(f"""case when "{f}" is null then '{f}' end""" for f in sorted(C.FEATURES))}], lambda x: x is not null) missing,
  {' + '.join(f'"{f}"' for f in C.FEATURES)} total from w)
select weighting, case when len(missing) > 0 then 'missing: ' || array_to_string(missing, ', ') else 'must sum to 1.0' end reason
from r where len(missing) > 0 or abs(total - 1.0) > 1e-9""")
def weighting_rejects(spark, d):
    """A scheme for each customer, some without a weight, most with another sum than one."""
    key = F.col("c_custkey")
    weights = {f: F.when(key % 7 != i, (key * (i + 1) % 5) / F.lit(10.0)) for i, f in enumerate(C.FEATURES)}
    return metrics.weighting_rejects(table(spark, d, "customer").select(key.alias("weighting"), *[c.alias(f) for f, c in weights.items()]))


@query("parameter_rejects", """
with r as (select event_id, case when event_id % 11 = 0 then '  ' else event_type end query_text, case when event_id % 13 <> 0 then event_id % 7 - 1 end k, value / 100 alpha from events)
select event_id, array_to_string(list_filter([case when trim(query_text) = '' then 'blank query' end, case when coalesce(k <= 0, true) then 'k must be positive' end,
  case when not coalesce(alpha between 0 and 1, false) then 'alpha must lie between 0.0 and 1.0' end], lambda x: x is not null), '; ') reasons
from r where trim(query_text) = '' or coalesce(k <= 0, true) or not coalesce(alpha between 0 and 1, false)""")
def parameter_rejects(spark, d):
    """All events as requests with limits of their own."""
    n = F.col("event_id")
    rows = table(spark, d, "events").select(
        n, F.when(n % 11 == 0, "  ").otherwise(F.col("event_type")).alias("query_text"), F.when(n % 13 != 0, n % 7 - 1).alias("k"), (F.col("value") / 100).alias("alpha"))
    return topk.parameter_rejects(rows).select("event_id", F.array_join("reasons", "; ").alias("reasons"))
