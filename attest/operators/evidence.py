"""Evidence packs, prompts, answers and citation checks (A-01 .. A-11)."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import text as X
from ..schemas import ANSWER, VALIDATION

STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(STRINGS)


def _dotted(sections: Column) -> Column:
    return F.array_join(F.coalesce(sections, _none()), ".")


def _labelled(name: str, value: Column) -> Column:
    """``name: value``, null when the value is missing or empty."""
    return F.concat(F.lit(name), F.nullif(value.cast("string"), F.lit("")))


def source_label(rank: str = "rank") -> Column:
    """A-03: one readable line per evidence chunk."""
    return F.concat_ws(
        " | ",
        F.concat(F.lit("[S"), F.col(rank).cast("string"), F.lit("] "), F.coalesce("source_id", F.lit("Unknown source"))),
        _labelled("Authority: ", X.title_words(F.col("source_policy.authority_tier"))),
        _labelled("Status: ", F.replace("source_policy.currency_status", F.lit("_"), F.lit(" "))),
        _labelled("Heading: ", X.join_path(F.col("heading_path"))),
        _labelled("Section: ", _dotted(F.col("citation.section_ids"))),
        _labelled("PDF page: ", F.col("citation.pdf_page_start")),
        _labelled("Rule sheet: ", F.col("citation.tariff_rule_sheet")))


def locator(citation: str = "citation") -> Column:
    """A-05: where the evidence stands, in one line."""
    c = F.col(citation)
    line = F.concat_ws(
        " | ",
        _labelled("Section: ", _dotted(c["section_ids"])), _labelled("PDF page: ", c["pdf_page_start"]),
        _labelled("Printed page: ", c["printed_page_start"]), _labelled("Rule sheet: ", c["tariff_rule_sheet"]),
        _labelled("CPUC sheet: ", c["tariff_cpuc_sheet"]), _labelled("Advice letter: ", c["tariff_advice_letter"]),
        _labelled("Citation heading: ", X.join_path(c["heading_path"])))
    return F.when(line == "", "No citation locator available").otherwise(line)


def section_text(rank: str = "rank") -> Column:
    """A-02: the section of one chunk inside the evidence pack."""

    def or_else(value: Column, text: str) -> Column:
        return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(text))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value)

    return F.concat_ws(
        "\n",
        F.concat(F.lit("[S"), F.col(rank).cast("string"), F.lit("]")),
        field("Source ID", F.coalesce("source_id", F.lit("unknown"))),
        field("Authority tier", F.coalesce("source_policy.authority_tier", F.lit("unknown"))),
        field("Currency status", F.coalesce("source_policy.currency_status", F.lit("unknown"))),
        field("Heading", or_else(X.join_path(F.col("heading_path")), "Not available")),
        field("Section IDs", or_else(_dotted(F.col("citation.section_ids")), "Not available")),
        field("PDF page", or_else(F.col("citation.pdf_page_start"), "Not available")),
        F.lit("Evidence:"), X.strip(F.coalesce("evidence_text", F.lit(""))))


def evidence_pack(ranked: DataFrame, chunks: DataFrame, rank: str = "rank", score: str | None = None) -> DataFrame:
    """A-01, A-02, A-10: per query the label map, the evidence context and the snapshot.

    ``ranked`` holds the bounded final list per query; text joins only those rows.
    """
    rows = ranked.join(chunks, "chunk_id")
    label = F.concat(F.lit("S"), F.col(rank).cast("string"))
    snapshot = F.struct(
        F.col(rank).alias("retrieval_rank"), "chunk_id", "source_id",
        (F.col(score).cast("double") if score else F.lit(None).cast("double")).alias("score"), "heading_path",
        F.struct(F.col("citation.pdf_page_start").alias("pdf_page_start"),
                 F.col("citation.section_ids").alias("section_ids")).alias("citation"),
        F.struct(F.col("source_policy.authority_tier").alias("authority_tier"),
                 F.col("source_policy.currency_status").alias("currency_status")).alias("source_policy"),
        "evidence_text")
    entries = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("o"), label.alias("k"), F.col("chunk_id").alias("v"))))
    return rows.groupBy("query_id").agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], e["v"]))).alias("evidence_labels"),
        X.ordered_text(section_text(rank), F.col(rank), "\n\n---\n\n").alias("evidence_context"),
        X.ordered_list(snapshot, F.col(rank)).alias("evidence_snapshot"),
        X.ordered_list(label, F.col(rank)).alias("supplied_labels"))


def prompts(questions: DataFrame, packs: DataFrame) -> DataFrame:
    """A-03, A-08: question, evidence and allowed labels as one text; null prompt without evidence."""
    rows = questions.join(packs, "query_id", "left")
    prompt = F.concat(
        F.lit("Original user question:\n"), X.strip(F.col("query_text")), F.lit("\n\n\n\nRetrieved evidence:\n"),
        F.col("evidence_context"),
        F.lit("\n\n\n\nReturn a structured answer to the original user question. For every factual\n"
              "claim, set citation_labels only from this supplied-label set: "),
        F.array_join("supplied_labels", ", "),
        F.lit(".\nDo not invent labels, source locations, page numbers, or document status."))
    return rows.withColumn("prompt", prompt).withColumn("supplied_labels", F.coalesce("supplied_labels", _none()))


def bounded_answer(gap: str, steps: tuple[str, ...]) -> Column:
    """The answer given instead of an unsupported one."""
    return F.struct(
        F.lit("insufficient_evidence").alias("answer_status"), F.lit(C.INSUFFICIENT_MESSAGE).alias("direct_answer"),
        F.array().cast(ANSWER["claims"].dataType).alias("claims"), F.lit(C.UNCERTAINTY).alias("uncertainty_statement"),
        F.lit(None).cast("string").alias("clarifying_question"), F.array(F.lit(gap)).alias("evidence_gaps"),
        F.array(*[F.lit(s) for s in steps]).alias("research_next_steps"))


def citation_check(answer: Column, supplied: Column) -> Column:
    """A-06 as one expression: the validation struct of an answer."""
    claims = F.coalesce(answer["claims"], F.array().cast(ANSWER["claims"].dataType))
    supplied = F.coalesce(supplied, _none())
    labels = F.transform(claims, lambda c: F.coalesce(c["citation_labels"], _none()))
    used = F.array_sort(F.array_distinct(F.flatten(labels)))
    claim_errors = F.transform(labels, lambda ls, i: F.concat(
        F.when(F.size(ls) == 0, F.array(F.concat(F.lit("Claim "), i.cast("string"), F.lit(" has no citations")))).otherwise(_none()),
        F.flatten(F.transform(ls, lambda x: F.array_compact(F.array(
            F.when(~F.array_contains(supplied, x), F.concat(F.lit("Unknown citation label: "), x)),
            F.when(~x.rlike(r"^S\d+\n?$"), F.concat(F.lit("Invalid citation label syntax: "), x))))))))
    uncited = F.filter(F.transform(labels, lambda ls, i: F.when(F.size(ls) == 0, i)), lambda i: i.isNotNull())
    empty = (answer["answer_status"] == "insufficient_evidence") & (F.size(claims) > 0)
    errors = F.concat(F.flatten(claim_errors), F.when(
        F.coalesce(empty, F.lit(False)),
        F.array(F.lit("Answer status is 'insufficient_evidence' but contains factual claims"))).otherwise(_none()))
    return F.struct(
        (F.size(errors) == 0).alias("is_valid"), F.array_sort(F.array_distinct(supplied)).alias("supplied_labels"),
        used.alias("used_labels"), F.array_except(used, supplied).alias("unknown_labels"),
        uncited.cast("array<int>").alias("uncited_claim_indexes"), errors.alias("errors")).cast(VALIDATION)


def validate_citations(answers: DataFrame, packs: DataFrame | None = None) -> DataFrame:
    """A-06: add ``citation_validation``. Labels come from the pack, or from a column of the answers."""
    rows = answers if packs is None else answers.join(packs.select("query_id", "supplied_labels"), "query_id", "left")
    return rows.withColumn("citation_validation", citation_check(F.col("answer"), F.col("supplied_labels")))


def fail_closed(answers: DataFrame) -> DataFrame:
    """A-07, A-08, A-09: replace what may not be shown; the validation struct stays.

    ``answers``: answer, supplied_labels, citation_validation and generation_error.
    Nothing retrieved gives a valid bounded answer, a failed generation an
    invalid one, and so does an answer with bad citations.
    """
    nothing = F.size(F.coalesce("supplied_labels", _none())) == 0
    failed = F.col("generation_error").isNotNull()
    invalid = ~F.coalesce("citation_validation.is_valid", F.lit(False))
    empty = _validation(F.lit(True), _none(), _none())
    broken = _validation(F.lit(False), F.array_sort("supplied_labels"),
                         F.array(F.concat(F.lit("Generation failed: "), F.col("generation_error"))))
    shown = (
        F.when(nothing, bounded_answer(C.GAP_NO_EVIDENCE, C.STEPS_NO_EVIDENCE))
        .when(failed, bounded_answer(C.GAP_GENERATION, C.STEPS_RETRY))
        .when(invalid, bounded_answer(C.GAP_CITATIONS, C.STEPS_RETRY))
        .otherwise(F.col("answer")))
    check = F.when(nothing, empty).when(failed, broken).otherwise(F.col("citation_validation"))
    return answers.withColumn("fail_closed_triggered", ~nothing & ~failed & invalid).withColumn(
        "displayed_answer", shown).withColumn("citation_validation", check)


def _validation(valid: Column, supplied: Column, errors: Column) -> Column:
    return F.struct(
        valid.alias("is_valid"), supplied.alias("supplied_labels"), _none().alias("used_labels"),
        _none().alias("unknown_labels"), F.array().cast("array<int>").alias("uncited_claim_indexes"),
        errors.alias("errors")).cast(VALIDATION)


# A generator: (question, prompt, labels) in, answer dict out. The factory runs once per Python worker task.
Generator = Callable[[str, str, list[str]], dict]


def extractive_answer(first: Column, supplied: Column) -> Column:
    """A-09 default: a fixed answer that quotes the first sentence of the first evidence text and cites it."""
    said = X.strip(F.coalesce(first, F.lit("")))
    sentence = F.regexp_extract(said, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    text = F.when(sentence != "", sentence).otherwise(said)
    return F.struct(
        F.lit("answered").alias("answer_status"), text.alias("direct_answer"),
        F.array(F.struct(text.alias("text"), F.array(supplied[0]).alias("citation_labels"))).alias("claims"),
        F.lit(C.UNCERTAINTY).alias("uncertainty_statement"), F.lit(None).cast("string").alias("clarifying_question"),
        _none().alias("evidence_gaps"), _none().alias("research_next_steps"))


def generate(prompted: DataFrame, factory: Callable[[], Generator] | None = None) -> DataFrame:
    """A-09: add ``answer`` and ``generation_error``; a failing call becomes an error, not an exception."""
    has_evidence = F.size("supplied_labels") > 0
    if factory is None:
        answer = F.when(has_evidence, extractive_answer(F.try_element_at("evidence_snapshot", F.lit(1))["evidence_text"], F.col("supplied_labels")))
        return prompted.withColumn("answer", answer.cast(ANSWER)).withColumn("generation_error", F.lit(None).cast("string"))

    @F.pandas_udf(f"struct<answer:{ANSWER.simpleString()},error:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = factory()
        for questions, texts, labels in batches:
            answers, errors = [], []
            for q, p, ls in zip(questions, texts, labels):
                try:
                    answers.append(model(q, p, list(ls)) if len(ls) else None)
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 - reported per row
                    answers.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pd.DataFrame({"answer": answers, "error": pd.Series(errors, dtype=object)})

    out = prompted.withColumn("__g", run("query_text", "prompt", "supplied_labels"))
    return out.withColumn("answer", F.col("__g.answer")).withColumn("generation_error", F.col("__g.error")).drop("__g")


def evidence_cards(cached: DataFrame, key: str = "cache_id") -> DataFrame:
    """A-11: one display row per snapshot entry."""
    rows = cached.select(key, F.posexplode("evidence_snapshot").alias("place", "e"))
    tier = X.title_words(F.coalesce("e.source_policy.authority_tier", F.lit("unknown")))
    status = F.replace(F.coalesce("e.source_policy.currency_status", F.lit("unknown")), F.lit("_"), F.lit(" "))
    where = F.concat_ws(
        " | ", F.nullif(X.join_path(F.col("e.heading_path")), F.lit("")), _labelled("PDF page ", F.col("e.citation.pdf_page_start")),
        _labelled("Section ", _dotted(F.col("e.citation.section_ids"))))
    rank = F.coalesce("e.retrieval_rank", F.col("place") + 1)
    return rows.select(
        key, F.concat(F.lit("S"), rank.cast("string")).alias("citation_id"),
        F.coalesce("e.source_id", F.lit("Unknown source")).alias("source_title"),
        F.concat(tier, F.lit(" ("), status, F.lit(")")).alias("source_class"),
        F.nullif(where, F.lit("")).alias("page_or_section"), F.coalesce("e.evidence_text", F.lit("")).alias("excerpt"),
        rank.alias("retrieval_rank"))
