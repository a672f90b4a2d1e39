"""Fixed table schemas. Readers use these; nothing is inferred."""
from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRINGS = T.ArrayType(S)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CITATION = _struct(
    heading_path=STRINGS, pdf_page_start=I, pdf_page_end=I, printed_page_start=S, printed_page_end=S,
    section_ids=STRINGS, tariff_rule_sheet=S, tariff_cpuc_sheet=S, tariff_effective_date=S, tariff_advice_letter=S,
)
SOURCE_POLICY = _struct(authority_tier=S, retrieval_tier=S, currency_status=S)
BLOCK = _struct(
    block_id=S, document_id=S, source_id=S, source_hash=S, ordinal=L, block_type=S, text=S, heading_path=STRINGS,
    citation=CITATION, is_substantive=B, normalisation_flags=STRINGS, heading_level=I, heading=S,
)
CHUNK = _struct(
    chunk_id=S, schema_version=S, document_id=S, source_id=S, source_hash=S, chunk_ordinal=L, block_ids=STRINGS,
    block_types=STRINGS, heading_path=STRINGS, evidence_text=S, evidence_text_sha256=S, embedding_text=S,
    estimated_evidence_tokens=I, estimated_embedding_tokens=I, citation=CITATION, source_policy=SOURCE_POLICY,
    previous_chunk_id=S, next_chunk_id=S, chunking_flags=STRINGS,
)
EMBEDDING = _struct(chunk_id=S, embedding=T.ArrayType(T.FloatType()), model_id=S, embedded_at=T.TimestampType())
CLAIM = _struct(text=S, citation_labels=STRINGS)
ANSWER = _struct(
    answer_status=S, direct_answer=S, claims=T.ArrayType(CLAIM), uncertainty_statement=S, clarifying_question=S,
    evidence_gaps=STRINGS, research_next_steps=STRINGS,
)
VALIDATION = _struct(
    is_valid=B, supplied_labels=STRINGS, used_labels=STRINGS, unknown_labels=STRINGS,
    uncited_claim_indexes=T.ArrayType(I), errors=STRINGS,
)
EXPECTED = _struct(should_ask_clarification=B, should_state_insufficient_evidence=B)
QUESTION = _struct(id=S, category=S, question=S, expected_sources=STRINGS, expected_topics=STRINGS,
                   expected_behavior=EXPECTED, notes=S)
GOLD = _struct(source_id=S, document_id=S, heading_path=STRINGS, citation=CITATION, block_types=STRINGS,
               source_policy=SOURCE_POLICY)
QUERY = _struct(query_id=S, query_text=S, query_type=S, gold_chunk_id=S, gold_metadata=GOLD)
REWRITE = T.StructType([*QUERY.fields, T.StructField("hyde", S), T.StructField("expanded", S)])
EVAL_RESULT = _struct(query_id=S, technique=S, retriever=S, alpha=D, weighting=S, ndcg_at_10=D, mrr=D, recall_at_10=D)
SCORES = _struct(groundedness_score=I, relevance_score=I, completeness_score=I, citation_quality_score=I,
                 appropriate_uncertainty_score=I)
JUDGE_SCORE = T.StructType([
    *_struct(answer_record_run_id=S, question_id=S, prompt_version=S, category=S).fields, *SCORES.fields,
    T.StructField("composite_score", D)])
JUDGEMENT = _struct(candidate_a_scores=SCORES, candidate_b_scores=SCORES, winner=S, confidence_score=I)
PAIRWISE = _struct(question_id=S, comparison_id=S, comparison_cases=STRINGS, candidate_a_case_id=S,
                   candidate_b_case_id=S, judgement=JUDGEMENT)
HTML_ELEMENT = _struct(page_id=L, seq=I, block_type=S, heading_level=I, text=S)
PAGE = _struct(page_number=I, text=S)
RAW_PAGES_DOC = _struct(document_id=S, source_type=S, source=_struct(id=S, content_hash=S, title=S),
                        pages=T.ArrayType(PAGE))
BLOCKS_DOC = _struct(schema_version=S, document_id=S, source_type=S, source=_struct(id=S, content_hash=S, title=S),
                     blocks=T.ArrayType(BLOCK))
CHUNKS_DOC = _struct(schema_version=S, document_id=S, source=_struct(id=S, content_hash=S, title=S),
                     source_policy=SOURCE_POLICY, chunks=T.ArrayType(CHUNK))
