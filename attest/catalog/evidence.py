"""Evidence packs, prompts, generated answers and citation checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X
from ..operators import embed, evidence, monitor, vector_search
from ..operators.fetch import fetched
from ..operators.hybrid import overlap_scorer, rerank
from ..plans import answering
from ..schemas import ANSWER
from ..session import materialise
from . import query
from .common import CHUNKS_SQL, benchmark_queries, document_chunks, once, query_vectors, sql_strip, table, vector_table
from .retrieval import BENCH_QUERIES, _vector_sql, rerank_sql

PACK_SQL = f"""{CHUNKS_SQL}, queries as (select item_id query_id, text query_text from benchmark), {_vector_sql(BENCH_QUERIES, 50)},
{rerank_sql('reranked', 'vector_ranked', 'vector_rank')},
sections as (
  select query_id, rerank_rank, d.*, '[S' || rerank_rank || ']' || chr(10) || 'Source ID: ' || source_id || chr(10)
    || 'Authority tier: ' || tier || chr(10) || 'Currency status: current_candidate' || chr(10)
    || 'Heading: ' || array_to_string(heading_path, ' > ') || chr(10) || 'Section IDs: ' || array_to_string(sections, '.') || chr(10)
    || 'PDF page: ' || page || chr(10) || 'Evidence:' || chr(10) || {sql_strip('evidence_text')} section
  from reranked r join docs d on d.chunk_id = r.chunk_id),
packs as (
  select query_id, string_agg(section, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rerank_rank) evidence_context,
    string_agg('S' || rerank_rank, ', ' order by rerank_rank) labels, count(*) n from sections group by 1)
"""


@once
def final_lists(spark, d):
    """(best ten of each query, chunks of all candidates): vectors are searched once, texts are fetched once, for all that read them."""
    vector = materialise(vector_search.vector_topk(query_vectors(spark, d), vector_table(spark, d), C.CANDIDATES), "near")
    texts = fetched(document_chunks(spark, d), vector)
    final = rerank(vector, benchmark_queries(spark, d), texts, "vector_rank", overlap_scorer, characters=None)
    return materialise(final, "final"), texts


def packs(spark, d):
    return evidence.evidence_pack(*final_lists(spark, d), "rerank_rank", "reranker_score")


@query("evidence_pack", f"with {PACK_SQL} select query_id, sha256(evidence_context) context_hash, labels from packs")
def evidence_pack(spark, d):
    return packs(spark, d).select(
        "query_id", F.sha2("evidence_context", 256).alias("context_hash"), F.array_join("supplied_labels", ", ").alias("labels"))


@query("evidence_labels", f"with {PACK_SQL} select query_id, 'S' || rerank_rank label, chunk_id from sections")
def evidence_labels(spark, d):
    return packs(spark, d).select("query_id", F.explode("evidence_labels").alias("label", "chunk_id"))


@query("source_labels", f"""with {PACK_SQL}
select query_id, '[S' || rerank_rank || '] ' || source_id || ' | Authority: Tier ' || tier[6:] || ' | Status: current candidate | Heading: '
  || array_to_string(heading_path, ' > ') || ' | Section: ' || array_to_string(sections, '.') || ' | PDF page: ' || page as "label",
  'Section: ' || array_to_string(sections, '.') || ' | PDF page: ' || page locator
from sections""")
def source_labels(spark, d):
    final, texts = final_lists(spark, d)
    rows = final.join(texts, "chunk_id")
    return rows.select("query_id", evidence.source_label("rerank_rank").alias("label"), evidence.locator().alias("locator"))


@query("prompts", f"""with {PACK_SQL}
select query_id, sha256('Original user question:' || chr(10) || trim(query_text) || repeat(chr(10), 4) || 'Retrieved evidence:' || chr(10)
  || evidence_context || repeat(chr(10), 4) || 'Return a structured answer to the original user question. For every factual' || chr(10)
  || 'claim, set citation_labels only from this supplied-label set: ' || labels || '.' || chr(10)
  || 'Do not invent labels, source locations, page numbers, or document status.') prompt_hash
from queries left join packs using (query_id)""")
def prompts(spark, d):
    out = evidence.prompts(benchmark_queries(spark, d), packs(spark, d))
    return out.select("query_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query("evidence_cards", f"""with {PACK_SQL}
select query_id, 'S' || rerank_rank citation_id, source_id source_title, 'Tier ' || tier[6:] || ' (current candidate)' source_class,
  array_to_string(heading_path, ' > ') || ' | PDF page ' || page || ' | Section ' || array_to_string(sections, '.') page_or_section,
  sha256(evidence_text) excerpt, rerank_rank::int retrieval_rank
from sections""")
def evidence_cards(spark, d):
    return evidence.evidence_cards(packs(spark, d), "query_id").withColumn("excerpt", F.sha2("excerpt", 256))


@query("answering_pipeline")
def answering_pipeline(spark, d):
    """Question to checked answer with the extractive generator, as one plan."""
    prompted = evidence.prompts(benchmark_queries(spark, d), packs(spark, d))
    done = evidence.fail_closed(evidence.validate_citations(evidence.generate(prompted)))
    return done.select("query_id", "displayed_answer", "citation_validation", "fail_closed_triggered")


# --- a batch from question to answer ----------------------------------------------------------


def _counts():
    """A model that counts: length, blanks and three letters."""
    return lambda texts: [[float(len(t)), *(float(t.count(c)) for c in " ena")] for t in texts]


def _counted_sql(text: str) -> str:
    """Its vector in SQL: unit length, in single precision."""
    raw = f"[length({text})::double, {', '.join(f"(length({text}) - length(replace({text}, '{c}', '')))::double" for c in ' ena')}]"
    return f"list_transform({raw}, lambda x: (x / sqrt(list_sum(list_transform({raw}, lambda y: y * y))))::float)"


EMBEDDED_SQL = f"embedded as (select doc_id chunk_id, {_counted_sql('t')} v from (select doc_id, '{C.DOCUMENT_PREFIX}' || coalesce(text, '') t from documents))"


@query("counted_embeddings", f"with {EMBEDDED_SQL} select chunk_id, {', '.join(f'round(v[{i + 1}]::double, 6) v{i}' for i in range(5))} from embedded")
def counted_embeddings(spark, d):
    """All documents embedded by a model that SQL can count after."""
    out = embed.embed(document_chunks(spark, d), "evidence_text", _counts)
    return out.select("chunk_id", *[F.round(F.col("embedding")[i].cast("double"), 6).alias(f"v{i}") for i in range(5)])


ANSWERING_SQL = f"""{CHUNKS_SQL}, {EMBEDDED_SQL},
all_questions as (select item_id query_id, case when item_id % 10 = 7 then '  ' else text end query_text from benchmark),
queries as (select query_id, {sql_strip('query_text')} query_text from all_questions where trim(query_text) <> '' and query_id % 4 <> 0),
asked as (select query_id, {_counted_sql('t')} q from (select query_id, '{C.QUERY_PREFIX}' || query_text t from queries)),
vector_ranked as (
  select query_id, chunk_id, row_number() over (partition by query_id order by round(list_cosine_similarity(q::double[], v::double[]), 10) desc, chunk_id) vector_rank
  from asked, embedded qualify vector_rank <= 50),
{rerank_sql('reranked', 'vector_ranked', 'vector_rank')},
firsts as (
  select query_id, max(case when rerank_rank = 1 then r.chunk_id end) first_chunk, count(*) n_labels,
    max(case when rerank_rank = 1 then {sql_strip('evidence_text')} end) said from reranked r join docs d on d.chunk_id = r.chunk_id group by 1)"""


@query("answering_batch", f"""with {ANSWERING_SQL}
select query_id, 'answered' outcome, first_chunk, n_labels, true is_valid,
  sha256(case when regexp_extract(said, '(?s)^(.*?[.!?])(?:\\s|$)', 1) <> '' then regexp_extract(said, '(?s)^(.*?[.!?])(?:\\s|$)', 1) else said end) answer_sha256 from firsts
union all select query_id, 'cached', null, null, null, null from all_questions where trim(query_text) <> '' and query_id % 4 = 0
union all select query_id, 'rejected', null, null, null, null from all_questions where trim(query_text) = ''""")
def answering_batch(spark, d):
    """All items as questions: a quarter is cached, a tenth is blank, the others are embedded, searched for, reranked, answered and checked."""
    n = F.col("query_id")
    questions = benchmark_queries(spark, d).select(n, F.when(n % 10 == 7, "  ").otherwise(F.col("query_text")).alias("query_text"))
    version = "v3_few_shot_grounded_rag"
    cache = questions.where(n % 4 == 0).select(X.strip(F.col("query_text")).alias("question_text"), monitor.config_hash(F.lit(version), F.lit(C.FINAL_K), F.lit("default")).alias("config_hash"),
                                               n.alias("cache_id"))
    chunks = document_chunks(spark, d)
    vectors = embed.embed(chunks, "evidence_text", _counts).select("chunk_id", "embedding")
    hits, answered, rejected = answering.answer_batch(questions, cache, vectors, chunks, _counts, prompt_version=version)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("first_chunk", "long"), ("n_labels", "long"), ("is_valid", "boolean"), ("answer_sha256", "string"))]
    new = answered.select("query_id", F.lit("answered").alias("outcome"), F.col("evidence_labels")["S1"].alias("first_chunk"), F.size("supplied_labels").cast("long").alias("n_labels"),
                          F.col("citation_validation.is_valid").alias("is_valid"), F.sha2("displayed_answer.direct_answer", 256).alias("answer_sha256"))
    return new.union(hits.select("query_id", F.lit("cached"), *none)).union(rejected.select("query_id", F.lit("rejected"), *none))


# --- answers made of conversations ------------------------------------------------------------

# One answer per conversation: every turn is a claim, labelled by its number; some labels are unknown,
# malformed or missing, and some answers claim to have no evidence.


def conversation_answers(spark, d):
    turn = F.col("turn")
    labels = (
        F.when(turn % 5 == 4, F.array().cast("array<string>"))
        .when(F.col("role") == "system", F.array(F.lit("page 3")))
        .otherwise(F.array(F.concat(F.lit("S"), (turn + 1).cast("string")), F.concat(F.lit("S"), (turn % 3 + 1).cast("string")))))
    claim = F.struct(turn.alias("turn"), F.struct(F.col("text").alias("text"), labels.alias("citation_labels")).alias("claim"))
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(claim)), lambda c: c["claim"]).alias("claims"))
    status = F.when(F.col("query_id") % 7 == 3, "insufficient_evidence").otherwise("answered")
    answer = F.struct(
        status.alias("answer_status"), F.concat(F.lit("answer "), "query_id").alias("direct_answer"), F.col("claims").alias("claims"),
        F.lit(C.UNCERTAINTY).alias("uncertainty_statement"), F.lit(None).cast("string").alias("clarifying_question"),
        F.array().cast("array<string>").alias("evidence_gaps"), F.array().cast("array<string>").alias("research_next_steps"))
    supplied = F.when(F.col("query_id") % 11 == 5, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("S"), i.cast("string"))))
    error = F.when(F.col("query_id") % 13 == 7, "TimeoutError: no answer")
    return rows.select(
        "query_id", answer.cast(ANSWER).alias("answer"), supplied.alias("supplied_labels"), error.alias("generation_error"))


CLAIMS_SQL = """
claims as (
  select conv_id query_id, row_number() over (partition by conv_id order by turn) - 1 i,
    case when turn % 5 = 4 then []::varchar[] when role = 'system' then ['page 3'] else ['S' || (turn + 1), 'S' || (turn % 3 + 1)] end labels
  from conversations),
supplied as (
  select query_id, case when query_id % 11 = 5 then []::varchar[] else ['S1', 'S2', 'S3', 'S4', 'S5', 'S6'] end supplied
  from (select distinct conv_id query_id from conversations)),
uses as (
  select c.query_id, i, generate_subscripts(labels, 1) j, unnest(labels) label, s.supplied from claims c join supplied s using (query_id)),
errors as (
  select query_id, i, 0 j, 0 o, 'Claim ' || i || ' has no citations' e from claims where len(labels) = 0
  union all select query_id, i, j, 1, 'Unknown citation label: ' || label from uses where not list_contains(supplied, label)
  union all select query_id, i, j, 2, 'Invalid citation label syntax: ' || label from uses where not regexp_matches(label, '^S\\d+$')
  union all select query_id, 1000000, 0, 3, 'Answer status is ''insufficient_evidence'' but contains factual claims'
    from supplied where query_id % 7 = 3),
checked as (
  select s.query_id, len(s.supplied) n_supplied,
    coalesce((select string_agg(e, '; ' order by i, j, o) from errors x where x.query_id = s.query_id), '') errors,
    coalesce((select string_agg(distinct label, ',' order by label) from uses u where u.query_id = s.query_id), '') used_labels,
    coalesce((select string_agg(distinct label, ',' order by label) from uses u where u.query_id = s.query_id
      and not list_contains(u.supplied, label)), '') unknown_labels,
    coalesce((select string_agg(i::varchar, ',' order by i) from claims c where c.query_id = s.query_id and len(labels) = 0), '') uncited
  from supplied s)
"""


@query("citation_validation", f"with {CLAIMS_SQL} select query_id, errors = '' is_valid, errors, used_labels, unknown_labels, uncited from checked")
def citation_validation(spark, d):
    out = evidence.validate_citations(conversation_answers(spark, d)).select("query_id", "citation_validation.*")
    return out.select(
        "query_id", "is_valid", F.array_join("errors", "; ").alias("errors"), F.array_join("used_labels", ",").alias("used_labels"),
        F.array_join("unknown_labels", ",").alias("unknown_labels"),
        F.array_join(F.col("uncited_claim_indexes").cast("array<string>"), ",").alias("uncited"))


@query("fail_closed", f"""with {CLAIMS_SQL}
select query_id, n_supplied > 0 and query_id % 13 <> 7 and errors <> '' fail_closed_triggered,
  case when n_supplied = 0 or query_id % 13 = 7 or errors <> '' or query_id % 7 = 3 then 'insufficient_evidence' else 'answered' end answer_status,
  case when n_supplied = 0 then '{C.GAP_NO_EVIDENCE}' when query_id % 13 = 7 then '{C.GAP_GENERATION}'
    when errors <> '' then '{C.GAP_CITATIONS}' else '' end gap,
  n_supplied = 0 or (query_id % 13 <> 7 and errors = '') is_valid
from checked""")
def fail_closed(spark, d):
    out = evidence.fail_closed(evidence.validate_citations(conversation_answers(spark, d)))
    return out.select(
        "query_id", "fail_closed_triggered", "displayed_answer.answer_status",
        F.array_join("displayed_answer.evidence_gaps", " ").alias("gap"), "citation_validation.is_valid")
