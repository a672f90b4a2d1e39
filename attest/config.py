"""Settings and lookup values.

Fixed values: the numbers, names, patterns and messages in this module are part
of the result format and have to be exactly these for results to agree.
"""
from __future__ import annotations

from dataclasses import dataclass, field

SCHEMA_VERSION = "1.0"

# Chunk limits, in estimated tokens.
SOFT_MAX_TOKENS = 500
HARD_MAX_TOKENS = 750
OVERLAP_TOKENS = 90

# Prefixes put before a text ahead of embedding.
DOCUMENT_PREFIX = "search_document: "
QUERY_PREFIX = "search_query: "
EMBED_BATCH = 64
EMBED_ATTEMPTS = 3

# Retrieval.
CANDIDATES = 50
FINAL_K = 10
RRF_OFFSET = 1
HYBRID_ALPHA = 0.5
ALPHAS = (0.3, 0.5, 0.7)
RERANK_CHARACTERS = 450
EXPANSION_TERMS = 5

# Relevance weights per scheme; each scheme sums to one.
FEATURES = ("source", "section", "page", "block_type", "authority")
WEIGHTINGS = {
    "equal": {"source": 0.20, "section": 0.20, "page": 0.20, "block_type": 0.20, "authority": 0.20},
    "source_heavy": {"source": 0.40, "section": 0.20, "page": 0.15, "block_type": 0.15, "authority": 0.10},
    "section_heavy": {"source": 0.15, "section": 0.40, "page": 0.20, "block_type": 0.15, "authority": 0.10},
    "page_heavy": {"source": 0.15, "section": 0.20, "page": 0.40, "block_type": 0.15, "authority": 0.10},
    "authority_heavy": {"source": 0.10, "section": 0.20, "page": 0.20, "block_type": 0.20, "authority": 0.30},
}
RELEVANT_ABOVE = 0.5
PAGE_DISTANCE = 2
RETRIEVERS = ("lexical", "vector", "hybrid", "vector_rerank", "hybrid_rerank")
RERANKED = ("vector_rerank", "hybrid_rerank")
COMPOSITE = {"ndcg_at_10": 0.5, "mrr": 0.3, "recall_at_10": 0.2}

# Answer statuses and their display labels.
STATUS_LABELS = {
    "answered": "Answered",
    "partial": "Partial",
    "needs_clarification": "Needs clarification",
    "insufficient_evidence": "Insufficient evidence",
    "high_stakes_boundary": "High-stakes boundary",
}
DEFAULT_STATUS_LABEL = "Answered"
RATINGS = ("helpful", "not_helpful")
SCORE_FIELDS = (
    "groundedness_score", "relevance_score", "completeness_score",
    "citation_quality_score", "appropriate_uncertainty_score",
)
JUDGE_WEIGHTS = {
    "groundedness_score": 0.30, "relevance_score": 0.20, "completeness_score": 0.20,
    "citation_quality_score": 0.20, "appropriate_uncertainty_score": 0.10,
}

# Four answer conditions: (case, prompt version, sees evidence, validation applies, fails closed).
CASES = (
    ("naive_no_evidence", "naive_general_knowledge", False, False, False),
    ("v3_no_evidence", "v3_few_shot_grounded_rag", False, True, False),
    ("zero_shot_rag", "v1_direct_rag", True, True, False),
    ("full_v3_rag", "v3_few_shot_grounded_rag", True, True, True),
)
COMPARISONS = (
    ("naive_no_evidence", "zero_shot_rag"),
    ("zero_shot_rag", "full_v3_rag"),
    ("naive_no_evidence", "full_v3_rag"),
    ("naive_no_evidence", "v3_no_evidence"),
    ("v3_no_evidence", "full_v3_rag"),
)

# English stop words of the published Snowball list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don should now"
).split()

# Patterns for printed page labels, numbered sections and sheet metadata.
PRINTED_PAGE = r"(?iU)^(?:Part\s+\d+\s*\|\s*)?P\s*a\s*g\s*e\s+([\w.-]+)$"
PRINTED_PAGE_LINES = 8  # where a label may stand at most, if a caller asks for a bound
DEEPEST_HEADING = 12
NUMBERED_SECTION = r"^(\d+(?:\.\d+){1,4})\s+(.+)$"
SHEET_PATTERNS = {
    "tariff_rule_sheet": r"(?i)\bRule\s+21\s+Sheet\s+(\d+)\b",
    "tariff_cpuc_sheet": r"(?i)\b(?:Original|Revised)\s+Cal\.\s+PUC\s+Sheet\s+No\.\s+(\d+(?:-[A-Z])?)",
    "tariff_effective_date": r"\bEffective\s+([A-Z][a-z]+\s+\d{1,2},\s+\d{4})\b",
    "tariff_advice_letter": r"(?i)\bAdvice\s+(\d+(?:-[A-Z])?)\b",
}
SUPERSEDED_SHEET = r"(?i)Cancelling\s+Revised\s+Cal\.\s+PUC\s+Sheet\s+No\.\s*([0-9A-Z\-]+)"
SUPERSEDED_BYTES = 200_000  # what is searched at most, if a caller asks for a bound
CONTENTS_MARK = "A. TABLE OF CONTENTS"
NEVER_HEADINGS = ("(Continued)", "A. TABLE OF CONTENTS", "A. TABLE OF CONTENTS (Continued)")
ADMIN_PATTERNS = (r"^\([A-Z]\)$", r"^\|$", r"(?i)^\d+C\d+\s+Resolution\b")
ADMIN_STARTS = (
    "Southern California Edison", "Rosemead, California", "Rule 21 Sheet", "GENERATING FACILITY INTERCONNECTIONS",
    "(Continued)", "(To be inserted by utility)", "Advice ", "Decision ",
)
LIST_START = r"(?i)^(?:\d+\.|[a-z]\)|[A-Z]\)|[ivxlcdm]+\))\s+"
BULLETS = ("•", "-", "–")

# Text of the bounded answers.
INSUFFICIENT_MESSAGE = (
    "I do not have enough retrieved evidence to answer that reliably. "
    "Please ask a more specific question or consult the cited source documents."
)
UNCERTAINTY = "This is research assistance only, not legal, engineering, regulatory, or compliance advice."
GAP_NO_EVIDENCE = "No relevant evidence was retrieved from the knowledge base."
GAP_GENERATION = "The answer-generation service failed before it could produce a validated answer."
GAP_CITATIONS = (
    "The generated response contained citations that could not be validated against the supplied evidence."
)
STEPS_NO_EVIDENCE = (
    "Rephrase the question with more specific technical terms.", "Consult the source documents directly.",
)
STEPS_RETRY = ("Retry the question.",)


@dataclass(frozen=True)
class PageRules:
    """Cleaning and heading rules of one source of numbered pages."""

    skip_pages: tuple[int, ...] = ()
    repeated_lines: tuple[str, ...] = ()
    part_patterns: tuple[str, ...] = ()
    section_patterns: tuple[str, ...] = ()
    clause_patterns: tuple[str, ...] = ()
    lettered: bool = False


@dataclass(frozen=True)
class HtmlRules:
    """Exact heading paths and texts a source drops."""

    drop_paths: tuple[str, ...] = ()
    drop_texts: tuple[str, ...] = ()


@dataclass(frozen=True)
class ChunkLimits:
    soft: int = SOFT_MAX_TOKENS
    hard: int = HARD_MAX_TOKENS
    overlap: int = OVERLAP_TOKENS
    prepend_heading: bool = True


@dataclass(frozen=True)
class Settings:
    """S-14: defaults overridden per source."""

    default: dict = field(default_factory=dict)
    sources: dict = field(default_factory=dict)

    def of(self, source_id: str) -> dict:
        return {**self.default, **self.sources.get(source_id, {})}
