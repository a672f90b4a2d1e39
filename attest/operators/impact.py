"""Answer conditions and blinded pairwise comparison (I-01 .. I-09)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from .quality import counter_map
from .topk import exact_median, last_wins

STRINGS = "array<string>"


def expand_cases(questions: DataFrame, cases: Sequence[tuple] = C.CASES) -> DataFrame:
    """I-01: each question under every condition; conditions without evidence lose theirs.

    ``questions``: query_id, query_text, supplied_labels, evidence_context.
    """
    names = ("case_id", "prompt_version", "sees_evidence", "citation_validation_applicable", "fails_closed")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, case)]) for case in cases])
    out = questions.withColumn("c", F.explode(rows)).select(*questions.columns, "c.*")
    return out.withColumn(
        "supplied_labels", F.when(F.col("sees_evidence"), F.col("supplied_labels")).otherwise(F.array().cast(STRINGS))
    ).withColumn("evidence_context", F.when(F.col("sees_evidence"), F.col("evidence_context")))


def percentage(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 2)


def _size(c: str) -> Column:
    return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))


def case_summary(answers: DataFrame) -> DataFrame:
    """I-02, I-04, I-05: success, latency, claims, citations and expected behaviour per case.

    ``answers``: case_id, generation_error, generation_latency_ms, answer_status, claims, clarifying_question,
    citation_validation_applicable, citation_validation, supplied_labels, fail_closed_triggered, expected_behavior.
    """
    ok = F.col("generation_error").isNull()
    used = ok & F.coalesce("citation_validation_applicable", F.lit(False))
    v = "citation_validation."
    asks = ok & F.coalesce("expected_behavior.should_ask_clarification", F.lit(False))
    declines = ok & F.coalesce("expected_behavior.should_state_insufficient_evidence", F.lit(False))
    asked = asks & (F.col("answer_status") == "needs_clarification") & (F.coalesce("clarifying_question", F.lit("")) != "")
    declined = declines & (F.col("answer_status") == "insufficient_evidence") & (_size("claims") == 0)

    def total(when: Column, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, what)), F.lit(0))

    out = answers.groupBy("case_id").agg(
        F.count("*").alias("total_records"), F.count_if(ok).alias("generation_success_count"),
        F.round(F.avg(F.when(ok, F.col("generation_latency_ms"))), 4).alias("mean_generation_latency_ms"),
        F.round(F.avg(F.when(ok, _size("claims"))), 4).alias("mean_claim_count"),
        F.count_if(used).alias("citation_validation_applicable_count"),
        F.count_if(used & F.coalesce(v + "is_valid", F.lit(False))).alias("citation_label_valid_count"),
        total(used, _size(v + "unknown_labels")).alias("unknown_label_count"),
        total(used, _size(v + "uncited_claim_indexes")).alias("uncited_claim_count"),
        total(ok, _size("supplied_labels")).alias("evidence_labels_supplied_count"),
        total(used, _size(v + "used_labels")).alias("evidence_labels_used_count"),
        F.count_if(ok & F.coalesce("fail_closed_triggered", F.lit(False))).alias("fail_closed_triggered_count"),
        F.count_if(asks).alias("clarification_total"), F.count_if(asked).alias("clarification_passed"),
        F.count_if(declines).alias("insufficient_total"), F.count_if(declined).alias("insufficient_passed"))
    middle = exact_median(answers.where(ok), ["case_id"], "generation_latency_ms", "median_generation_latency_ms")
    out = out.join(middle.withColumn("median_generation_latency_ms", F.round("median_generation_latency_ms", 4)), "case_id", "left")
    for name, part, whole in (
        ("generation_success_rate_percent", "generation_success_count", "total_records"),
        ("citation_label_valid_rate_percent", "citation_label_valid_count", "citation_validation_applicable_count"),
        ("evidence_label_utilisation_percent", "evidence_labels_used_count", "evidence_labels_supplied_count"),
        ("clarification_rate_percent", "clarification_passed", "clarification_total"),
        ("insufficient_rate_percent", "insufficient_passed", "insufficient_total"),
    ):
        out = out.withColumn(name, percentage(F.col(part), F.col(whole)))
    return out


def case_status_counts(answers: DataFrame) -> DataFrame:
    """I-03: answer statuses per case; an answer without status counts as failed."""
    return answers.groupBy("case_id", F.coalesce("answer_status", F.lit("generation_failed")).alias("k")).count()


def case_status_map(answers: DataFrame) -> DataFrame:
    return counter_map(case_status_counts(answers), "answer_status_counts", "case_id")


def comparison_id(left: Column, right: Column) -> Column:
    return F.concat(left, F.lit("__vs__"), right)


def blind_first(question: Column, comparison: Column, seed: int) -> Column:
    """I-07: whether the left case is shown first, from a seeded hash."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), question.cast("string"), comparison), 256)
    return F.conv(F.substring(digest, 16, 1), 16, 10).cast("int") % 2 == 0


def pair_candidates(answers: DataFrame, pairs: Sequence[tuple[str, str]] = C.COMPARISONS, seed: int = 42,
                    done: DataFrame | None = None, order: str = "ingest_seq") -> DataFrame:
    """I-06, I-07: pairs to judge, blind-ordered; only answers without error, the last one per question and case.

    A pair is formed by gathering the two rows of a (question, comparison) key,
    so no answer ever meets one outside its own comparison.
    """
    latest = last_wins(answers.where(F.col("generation_error").isNull()).select("question_id", "case_id", "answer", order),
                       ["question_id", "case_id"], [order])
    sides = F.array(*[
        F.struct(F.lit(a).alias("left_case"), F.lit(b).alias("right_case")) for a, b in pairs])
    mine = F.filter(sides, lambda p: (p["left_case"] == F.col("case_id")) | (p["right_case"] == F.col("case_id")))
    rows = latest.withColumn("p", F.explode(mine)).select("question_id", "case_id", "answer", "p.*")
    left, right = F.col("case_id") == F.col("left_case"), F.col("case_id") == F.col("right_case")
    both = rows.groupBy("question_id", "left_case", "right_case").agg(
        F.max(F.when(left, F.struct("answer"))).alias("l"), F.max(F.when(right, F.struct("answer"))).alias("r"),
    ).where(F.col("l").isNotNull() & F.col("r").isNotNull())
    both = both.withColumn("comparison_id", comparison_id(F.col("left_case"), F.col("right_case")))
    if done is not None:
        both = both.join(done.select("question_id", "comparison_id").distinct(), ["question_id", "comparison_id"], "left_anti")
    first = blind_first(F.col("question_id"), F.col("comparison_id"), seed)

    def pick(a: Column, b: Column) -> Column:
        return F.when(first, a).otherwise(b)

    return both.select(
        "question_id", "comparison_id", F.array("left_case", "right_case").alias("comparison_cases"),
        pick(F.col("left_case"), F.col("right_case")).alias("candidate_a_case_id"),
        pick(F.col("right_case"), F.col("left_case")).alias("candidate_b_case_id"),
        pick(F.col("l.answer"), F.col("r.answer")).alias("candidate_a_answer"),
        pick(F.col("r.answer"), F.col("l.answer")).alias("candidate_b_answer"))


def pairwise_wins(judgements: DataFrame) -> DataFrame:
    """I-08: wins, ties, rates and mean confidence per comparison; failed judgements do not count."""
    rows = judgements.where(F.col("judgement").isNotNull())
    winner = F.when(F.col("judgement.winner") == "candidate_a", F.col("candidate_a_case_id")).when(
        F.col("judgement.winner") == "candidate_b", F.col("candidate_b_case_id"))
    rows = rows.withColumn("won", winner)
    out = rows.groupBy(
        "comparison_id", F.col("comparison_cases")[0].alias("left_case_id"), F.col("comparison_cases")[1].alias("right_case_id")
    ).agg(
        F.count("*").alias("total_judgements"),
        F.count_if(F.col("won") == F.col("comparison_cases")[0]).alias("left_wins"),
        F.count_if(F.col("won") == F.col("comparison_cases")[1]).alias("right_wins"),
        F.count_if(F.col("won").isNull()).alias("ties"),
        F.round(F.avg("judgement.confidence_score"), 4).alias("mean_judge_confidence"))
    for name, part in (("left_win_rate_percent", "left_wins"), ("right_win_rate_percent", "right_wins"), ("tie_rate_percent", "ties")):
        out = out.withColumn(name, percentage(F.col(part), F.col("total_judgements")))
    return out


def pooled_scores(judgements: DataFrame) -> DataFrame:
    """I-09: mean of each score field per case over both sides of all comparisons."""
    rows = judgements.where(F.col("judgement").isNotNull())
    sides = F.array(*[
        F.struct(F.col(f"candidate_{s}_case_id").alias("case_id"), F.lit(f).alias("field"),
                 F.col(f"judgement.candidate_{s}_scores.{f}").cast("double").alias("score"))
        for s in ("a", "b") for f in C.SCORE_FIELDS])
    return rows.select(F.explode(sides).alias("s")).select("s.*").groupBy("case_id", "field").agg(
        F.round(F.avg("score"), 4).alias("mean_score"))
