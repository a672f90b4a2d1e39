"""Answer-quality and pairwise summaries over the event log, read as run records."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import answers, impact
from . import query
from .common import table

# Events as answer records: the user is the question, the event type the prompt version.
RECORDS_SQL = """
records as (
  select event_id ingest_seq, 'q' || user_id question_id, event_type prompt_version, 'run' || (event_id % 5) run_id,
    case when event_id % 9 <> 4 then value < 150 end is_valid, value from events)
"""
# Events as judge scores of runs, some of unknown runs and questions.
SCORES_SQL = """
scores as (
  select *, round(0.30 * groundedness_score + 0.20 * relevance_score + 0.20 * completeness_score + 0.20 * citation_quality_score
    + 0.10 * appropriate_uncertainty_score, 4)::double composite_score
  from (select 'run' || (event_id % 6) answer_record_run_id, 'q' || (user_id * 2) question_id, event_type prompt_version,
    1 + event_id % 5 groundedness_score, 1 + (event_id // 5) % 5 relevance_score, 1 + (event_id // 7) % 5 completeness_score,
    1 + (event_id // 11) % 5 citation_quality_score, 1 + (event_id // 13) % 5 appropriate_uncertainty_score
    from events))
"""


def records(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        e.alias("ingest_seq"), F.concat(F.lit("q"), "user_id").alias("question_id"), F.col("event_type").alias("prompt_version"),
        F.concat(F.lit("run"), e % 5).alias("run_id"), F.when(e % 9 != 4, F.col("value") < 150).alias("is_valid"), "value")


def judge_scores(spark, d):
    e = F.col("event_id")
    fields = [(1 + F.floor(e / n) % 5).cast("int").alias(f) for n, f in zip((1, 5, 7, 11, 13), C.SCORE_FIELDS)]
    rows = table(spark, d, "events").select(
        F.concat(F.lit("run"), e % 6).alias("answer_record_run_id"), F.concat(F.lit("q"), F.col("user_id") * 2).alias("question_id"),
        F.col("event_type").alias("prompt_version"), *fields)
    return rows.withColumn("composite_score", answers.judge_composite())


@query("first_answers", f"""with {RECORDS_SQL}
select question_id, prompt_version, min(ingest_seq) ingest_seq, arg_min(value, ingest_seq) as "value" from records group by 1, 2""")
def first_answers(spark, d):
    return answers.first_answers(records(spark, d)).select("question_id", "prompt_version", "ingest_seq", "value")


MEANS_SQL = ", ".join(f"avg({c}) {c}" for c in answers.MEANS)
SUMMARY_SQL = f"""{RECORDS_SQL}, {SCORES_SQL},
firsts as (select * from records qualify row_number() over (partition by question_id, prompt_version order by ingest_seq) = 1),
usable as (
  select * from scores s where exists (select 1 from records r where r.question_id = s.question_id and r.prompt_version = s.prompt_version)
    and exists (select 1 from records r where r.run_id = s.answer_record_run_id and r.prompt_version = s.prompt_version)),
by_question as (select prompt_version, question_id, {MEANS_SQL} from usable group by 1, 2),
judged as (select prompt_version, {', '.join(f'avg({c}) {n}' for c, n in answers.MEANS.items())}, stddev_pop(composite_score) std_composite,
  max(composite_score) best_composite, min(composite_score) worst_composite from by_question group by 1),
prompts as (
  select f.prompt_version, total_answers, citation_valid_count, citation_valid_count / total_answers citation_valid_rate,
    {', '.join(f'round(coalesce({c}, 0), 6) {c}' for c in [*answers.MEANS.values(), 'std_composite', 'best_composite', 'worst_composite'])}
  from (select prompt_version, count(*) total_answers, count(*) filter (is_valid) citation_valid_count from firsts group by 1) f
  left join judged j on j.prompt_version = f.prompt_version)
"""


def _summary(spark, d):
    out = answers.prompt_summary(records(spark, d), judge_scores(spark, d))
    measures = [*answers.MEANS.values(), "std_composite", "best_composite", "worst_composite"]
    return out.select(*[F.round(c, 6).alias(c) if c in measures else F.col(c) for c in out.columns])


@query("prompt_summary", f"with {SUMMARY_SQL} select * from prompts")
def prompt_summary(spark, d):
    return _summary(spark, d)


@query("prompt_selected", f"""with {SUMMARY_SQL}
select prompt_version, mean_composite from prompts where citation_valid_rate >= 0.6
order by mean_composite desc, mean_groundedness desc, prompt_version limit 1""")
def prompt_selected(spark, d):
    return answers.select_prompt(_summary(spark, d), 0.6).select("prompt_version", "mean_composite")


@query("answer_totals", f"""with {RECORDS_SQL}, {SCORES_SQL}
select (select count(*) from records) answer_records,
  (select count(*) from (select distinct question_id, prompt_version from records)) unique_answers, (select count(*) from scores) judge_rows""")
def answer_totals(spark, d):
    return answers.evaluation_totals(records(spark, d), judge_scores(spark, d))


# --- four conditions --------------------------------------------------------------------------

CASE_NAMES = [c[0] for c in C.CASES]
CASES_SQL = "case event_id % 4 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(CASE_NAMES)) + " end"
CASE_ROWS_SQL = f"""
cases as (
  select {CASES_SQL} case_id, event_id % 17 <> 3 ok, value latency, event_id % 3 n_claims, event_id % 4 > 0 applicable,
    event_id % 4 > 0 and event_id % 5 <> 0 valid, event_id % 2 n_unknown, event_id % 3 n_uncited, event_id % 8 n_supplied, event_id % 5 n_used,
    event_id % 19 = 0 closed, event_id % 6 = 0 asks, event_id % 10 = 5 declines,
    case event_id % 3 when 0 then 'needs_clarification' when 1 then 'answered' when 2 then 'insufficient_evidence' end status,
    event_id % 4 < 3 has_question
  from events)
"""


def case_rows(spark, d):
    e = F.col("event_id")

    def array_of(n):
        return F.transform(F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: i > 0), lambda i: F.concat(F.lit("S"), i.cast("string")))

    ok = e % 17 != 3
    case_id = F.element_at(F.array(*[F.lit(c) for c in CASE_NAMES]), (e % 4 + 1).cast("int"))
    check = F.struct(
        ((e % 4 > 0) & (e % 5 != 0)).alias("is_valid"), array_of(e % 2).alias("unknown_labels"), array_of(e % 3).alias("uncited_claim_indexes"),
        array_of(e % 5).alias("used_labels"))
    status = F.element_at(F.array(F.lit("needs_clarification"), F.lit("answered"), F.lit("insufficient_evidence")), (e % 3 + 1).cast("int"))
    return table(spark, d, "events").select(
        F.concat(F.lit("q"), "user_id").alias("question_id"), e.alias("ingest_seq"), case_id.alias("case_id"),
        F.when(~ok, "TimeoutError").alias("generation_error"), F.col("value").alias("generation_latency_ms"),
        F.when(ok, status).alias("answer_status"), array_of(e % 3).alias("claims"), F.when(e % 4 < 3, "which one?").alias("clarifying_question"),
        (e % 4 > 0).alias("citation_validation_applicable"), check.alias("citation_validation"), array_of(e % 8).alias("supplied_labels"),
        (e % 19 == 0).alias("fail_closed_triggered"), F.concat(F.lit("answer "), e).alias("answer"),
        F.struct((e % 6 == 0).alias("should_ask_clarification"), (e % 10 == 5).alias("should_state_insufficient_evidence")).alias("expected_behavior"))


def _percent(a: str, b: str) -> str:
    return f"round(100.0::double * ({a}) / nullif(({b}), 0), 2)"


@query("case_summary", f"""with {CASE_ROWS_SQL}
select case_id, count(*) total_records, count(*) filter (ok) generation_success_count, {_percent('count(*) filter (ok)', 'count(*)')} success_rate,
  round(avg(latency) filter (ok), 3) mean_latency, round(median(latency) filter (ok), 4) median_latency, round(avg(n_claims) filter (ok), 4) mean_claims,
  count(*) filter (ok and applicable) applicable, count(*) filter (ok and applicable and valid) valid,
  sum(n_unknown) filter (ok and applicable)::bigint is not null and true has_labels,
  coalesce(sum(n_unknown) filter (ok and applicable), 0)::bigint unknown_labels,
  coalesce(sum(n_uncited) filter (ok and applicable), 0)::bigint uncited_claims,
  {_percent('coalesce(sum(n_used) filter (ok and applicable), 0)', 'sum(n_supplied) filter (ok)')} utilisation,
  count(*) filter (ok and closed) fail_closed, count(*) filter (ok and asks) clarification_total,
  count(*) filter (ok and asks and status = 'needs_clarification' and has_question) clarification_passed,
  count(*) filter (ok and declines) insufficient_total, count(*) filter (ok and declines and status = 'insufficient_evidence' and n_claims = 0) insufficient_passed
from cases group by 1""".replace("\n  sum(n_unknown) filter (ok and applicable)::bigint is not null and true has_labels,", ""))
def case_summary(spark, d):
    return impact.case_summary(case_rows(spark, d)).select(
        "case_id", "total_records", "generation_success_count", F.col("generation_success_rate_percent").alias("success_rate"),
        F.round("mean_generation_latency_ms", 3).alias("mean_latency"), F.col("median_generation_latency_ms").alias("median_latency"),
        F.col("mean_claim_count").alias("mean_claims"), F.col("citation_validation_applicable_count").alias("applicable"),
        F.col("citation_label_valid_count").alias("valid"), F.col("unknown_label_count").alias("unknown_labels"),
        F.col("uncited_claim_count").alias("uncited_claims"), F.col("evidence_label_utilisation_percent").alias("utilisation"),
        F.col("fail_closed_triggered_count").alias("fail_closed"), "clarification_total", "clarification_passed", "insufficient_total",
        "insufficient_passed")


@query("case_status_counts", f"""with {CASE_ROWS_SQL}
select case_id, case when ok then status else 'generation_failed' end status, count(*) n from cases group by all""")
def case_status_counts(spark, d):
    return impact.case_status_map(case_rows(spark, d)).select("case_id", F.explode("answer_status_counts").alias("status", "n"))


@query("case_expansion", f"""
select item_id query_id, c.case_id, c.prompt_version, case when sees then 2 else 0 end n_labels, applicable, closes
from benchmark, (values {', '.join(str(tuple(c)) for c in C.CASES)}) c(case_id, prompt_version, sees, applicable, closes)""")
def case_expansion(spark, d):
    rows = table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array(F.lit("S1"), F.lit("S2")).alias("supplied_labels"), F.lit("pack").alias("evidence_context"))
    return impact.expand_cases(rows).select(
        "query_id", "case_id", "prompt_version", F.size("supplied_labels").alias("n_labels"),
        F.col("citation_validation_applicable").alias("applicable"), F.col("fails_closed").alias("closes"))


PAIRS_SQL = f"""{CASE_ROWS_SQL.replace('select ', "select 'q' || user_id question_id, event_id, ", 1)},
latest as (
  select question_id, case_id, 'answer ' || event_id answer from cases where ok
  qualify row_number() over (partition by question_id, case_id order by event_id desc) = 1),
pairs(l, r) as (values {', '.join(str(p) for p in C.COMPARISONS)}),
formed as (
  select a.question_id, l, r, l || '__vs__' || r comparison_id, a.answer la, b.answer ra,
    ('0x' || sha256('42|' || a.question_id || '|' || l || '__vs__' || r)[16])::int % 2 = 0 left_first
  from pairs join latest a on a.case_id = l join latest b on b.case_id = r and b.question_id = a.question_id)
"""


@query("pair_candidates", f"""with {PAIRS_SQL}
select question_id, comparison_id, case when left_first then l else r end candidate_a_case_id,
  case when left_first then la else ra end candidate_a_answer, case when left_first then ra else la end candidate_b_answer
from formed where not (question_id like '%7' and comparison_id like 'naive%')""")
def pair_candidates(spark, d):
    rows = case_rows(spark, d)
    questions = rows.where(F.col("question_id").endswith("7")).select("question_id").distinct()
    names = [f"{a}__vs__{b}" for a, b in C.COMPARISONS if a.startswith("naive")]
    done = questions.withColumn("comparison_id", F.explode(F.array(*[F.lit(n) for n in names])))
    return impact.pair_candidates(rows, done=done).select(
        "question_id", "comparison_id", "candidate_a_case_id", "candidate_a_answer", "candidate_b_answer")


def judgements(spark, d):
    """Events as pairwise judgements; every 23rd failed."""
    e = F.col("event_id")
    pairs = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in C.COMPARISONS])
    pair = F.element_at(pairs, (e % 5 + 1).cast("int"))
    left_first = F.floor(e / 5) % 2 == 0

    def scores(shift):
        return F.struct(*[(1 + (e + shift + i) % 5).cast("int").alias(f) for i, f in enumerate(C.SCORE_FIELDS)])

    winner = F.element_at(F.array(F.lit("candidate_a"), F.lit("candidate_b"), F.lit("tie")), (F.floor(e / 10) % 3 + 1).cast("int"))
    judgement = F.struct(scores(0).alias("candidate_a_scores"), scores(2).alias("candidate_b_scores"), winner.alias("winner"),
                         (1 + e % 5).cast("int").alias("confidence_score"))
    return table(spark, d, "events").select(
        F.concat(F.lit("q"), "user_id").alias("question_id"), F.concat_ws("__vs__", pair).alias("comparison_id"), pair.alias("comparison_cases"),
        F.when(left_first, pair[0]).otherwise(pair[1]).alias("candidate_a_case_id"),
        F.when(left_first, pair[1]).otherwise(pair[0]).alias("candidate_b_case_id"), F.when(e % 23 != 0, judgement).alias("judgement"))


JUDGED_SQL = f"""
pairs as (select row_number() over () - 1 i, l, r from (values {', '.join(str(p) for p in C.COMPARISONS)}) p(l, r)),
judged as (
  select event_id, l, r, case when (event_id // 5) % 2 = 0 then l else r end a, case when (event_id // 5) % 2 = 0 then r else l end b,
    (event_id // 10) % 3 w, 1 + event_id % 5 confidence
  from events join pairs on i = event_id % 5 where event_id % 23 <> 0),
won as (select *, case w when 0 then a when 1 then b end winner from judged)
"""


@query("pairwise_wins", f"""with {JUDGED_SQL}
select l || '__vs__' || r comparison_id, count(*) total_judgements, count(*) filter (winner = l) left_wins, count(*) filter (winner = r) right_wins,
  count(*) filter (winner is null) ties, {_percent('count(*) filter (winner = l)', 'count(*)')} left_win_rate_percent,
  {_percent('count(*) filter (winner is null)', 'count(*)')} tie_rate_percent, round(avg(confidence), 4) mean_judge_confidence
from won group by l, r""")
def pairwise_wins(spark, d):
    return impact.pairwise_wins(judgements(spark, d)).select(
        "comparison_id", "total_judgements", "left_wins", "right_wins", "ties", "left_win_rate_percent", "tie_rate_percent", "mean_judge_confidence")


@query("pooled_scores", f"""with {JUDGED_SQL},
sides as (select a case_id, event_id, 0 s from judged union all select b, event_id, 2 from judged),
fields as (select * from (values {', '.join(f"({i}, '{f}')" for i, f in enumerate(C.SCORE_FIELDS))}) f(i, field))
select case_id, field, round(avg(1 + (event_id + s + i) % 5), 4) mean_score from sides, fields group by 1, 2""")
def pooled_scores(spark, d):
    return impact.pooled_scores(judgements(spark, d))


@query("latency_median", "select event_type, median(value) median from events group by 1")
def latency_median(spark, d):
    from ..operators.topk import exact_median

    return exact_median(table(spark, d, "events"), ["event_type"], "value")
