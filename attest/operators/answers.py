"""Answer-quality summaries per prompt version (L-01 .. L-08)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from .monitor import one_row
from .topk import first_wins

MEANS = {
    "groundedness_score": "mean_groundedness", "relevance_score": "mean_relevance",
    "completeness_score": "mean_completeness", "citation_quality_score": "mean_citation_quality",
    "appropriate_uncertainty_score": "mean_uncertainty", "composite_score": "mean_composite",
}


def first_answers(answers: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """L-01: the first record per question and prompt."""
    return first_wins(answers, ["question_id", "prompt_version"], [order])


def judge_composite() -> Column:
    """L-02."""
    total = None
    for name, w in C.JUDGE_WEIGHTS.items():
        part = F.lit(w) * F.col(name)
        total = part if total is None else total + part
    return F.round(total, 4)


def usable_scores(scores: DataFrame, answers: DataFrame) -> DataFrame:
    """L-03: scores whose question is answered and whose run is known for the prompt."""
    questions = answers.select("question_id", "prompt_version").distinct()
    runs = answers.select(F.col("run_id").alias("answer_record_run_id"), "prompt_version").distinct()
    return scores.join(questions, ["question_id", "prompt_version"], "left_semi").join(
        runs, ["answer_record_run_id", "prompt_version"], "left_semi")


def prompt_summary(answers: DataFrame, scores: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """L-03 .. L-06: question means first, then means over questions.

    ``answers``: question_id, prompt_version, run_id, is_valid and the order column.
    """
    unique = first_answers(answers.select("question_id", "prompt_version", "is_valid", order), order)
    base = unique.groupBy("prompt_version").agg(
        F.count("*").alias("total_answers"),
        F.count_if(F.coalesce("is_valid", F.lit(False))).alias("citation_valid_count"))
    base = base.withColumn("citation_valid_rate", F.col("citation_valid_count") / F.col("total_answers"))
    by_question = usable_scores(scores, answers).groupBy("prompt_version", "question_id").agg(
        *[F.avg(c).alias(c) for c in MEANS])
    judged = by_question.groupBy("prompt_version").agg(
        *[F.avg(c).alias(n) for c, n in MEANS.items()],
        F.stddev_pop("composite_score").alias("std_composite"),
        F.max("composite_score").alias("best_composite"), F.min("composite_score").alias("worst_composite"))
    measures = [c for c in judged.columns if c != "prompt_version"]
    return base.join(judged, "prompt_version", "left").na.fill(0.0, measures)


def select_prompt(summary: DataFrame, min_validity: float = 1.0) -> DataFrame:
    """L-07: best composite, then groundedness, among prompts that meet the validity bar; empty if none does."""
    fit = summary.where(F.col("citation_valid_rate") >= min_validity)
    return fit.orderBy(F.desc("mean_composite"), F.desc("mean_groundedness"), F.asc("prompt_version")).limit(1)


def evaluation_totals(answers: DataFrame, scores: DataFrame) -> DataFrame:
    """L-08: one row of totals."""
    return one_row([
        answers.agg(F.count("*").alias("answer_records"),
                    F.count_distinct("question_id", "prompt_version").alias("unique_answers")),
        scores.agg(F.count("*").alias("judge_rows"))])
