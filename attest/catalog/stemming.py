"""Stems of the words of documents, and search with them."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import stem as S
from ..operators import lexical
from . import query
from .common import benchmark_queries, document_chunks
from .retrieval import BENCHMARK_SOURCE, LEXICAL_OUT, POSTINGS_SQL, TF_SQL, terms_sql

K = 10


def stems_sql(source: str) -> str:
    """CTEs that end in `stems` (word, stem) for the lexemes of a relation."""
    def cut(k: int, add: str = "") -> str:
        return f"left(w, length(w) - {k}) || '{add}'"

    def within(region: str, suffix: str) -> str:
        return f"length(w) - {len(suffix)} >= {region}"

    def preceded(suffix: str) -> str:
        return f"regexp_matches(w, '{S.BEFORE[suffix]}{suffix}$')" if suffix in S.BEFORE else "true"

    def suffixes(rules: list[tuple[str, str]]) -> str:
        return "case " + " ".join(f"when ends_with(w, '{s}') then {new}" for s, new in rules) + " else w end"

    def when(condition: str, new: str) -> str:
        return f"case when {condition} then {new} else w end"

    region = f"length(regexp_extract({{}}, '{S.REGION}'))"
    short_plural = f"case when length(w) > 4 then {cut(2)} else {cut(1)} end"
    steps = [
        suffixes([("sses", cut(2)), ("ied", short_plural), ("ies", short_plural), ("us", "w"), ("ss", "w"), ("s", when(f"regexp_matches(w, '{S.VOWEL}.+s$')", cut(1)))]),
        None,
        f"case when ends_with(w, 'eedly') then {when(within('r1', 'eedly'), cut(3))} when ends_with(w, 'eed') then {when(within('r1', 'eed'), cut(1))} "
        "else left(w, length(w) - length(ending)) end",
        f"case when ending = '' then w when regexp_matches(w, '(at|bl|iz)$') then w || 'e' when regexp_matches(w, '{S.DOUBLE_END}') then {cut(1)} "
        f"when regexp_matches(w, '{S.SHORT_END}') and r1 >= length(w) then w || 'e' else w end",
        when(f"regexp_matches(w, '^.+{S.OTHER}[yY]$')", cut(1, "i")),
        suffixes([(s, when(f"{within('r1', s)} and {preceded(s)}", cut(len(s), S.STEP_2[s]))) for s in S.longest_first(S.STEP_2)]),
        suffixes([(s, when(within("r2" if s == "ative" else "r1", s), cut(len(s), S.STEP_3[s]))) for s in S.longest_first(S.STEP_3)]),
        suffixes([(s, when(f"{within('r2', s)} and {preceded(s)}", cut(len(s)))) for s in S.longest_first(S.STEP_4)]),
        suffixes([("e", when(f"{within('r2', 'e')} or ({within('r1', 'e')} and not regexp_matches({cut(1)}, '{S.SHORT_END}'))", cut(1))),
                  ("l", when(f"{within('r2', 'l')} and ends_with(w, 'll')", cut(1)))]),
    ]
    kept = ", ".join(f"'{x}'" for x in S.KEPT_AFTER_PLURALS)
    parts = [f"""
s_words as (select distinct lexeme word, regexp_replace(regexp_replace(lexeme, '^y', 'Y'), '({S.VOWEL})y', '\\1Y', 'g') w from {source}),
s_first as (select *, case {' '.join(f"when starts_with(word, '{x}') then {len(x)}" for x in reversed(S.LONG_STARTS))}
  when {region.format('w')} > 0 then {region.format('w')} else length(w) end r1 from s_words),
s_0 as (select *, case when {region.format('w[r1 + 1:]')} > 0 then r1 + {region.format('w[r1 + 1:]')} else length(w) end r2, false done, '' ending from s_first)"""]
    for i, step in enumerate(steps):
        new = f"{step} as w" if step else (
            f"w in ({kept}) as done, case when regexp_matches(w, 'eed(ly)?$') then '' when regexp_matches(regexp_extract(w, '^(.*)(edly|ingly|ed|ing)$', 1), '{S.VOWEL}') "
            "then regexp_extract(w, '^(.*)(edly|ingly|ed|ing)$', 2) else '' end as ending")
        parts.append(f"s_{i + 1} as (select * replace ({new}) from s_{i})")
    whole = " ".join(f"when '{a}' then '{b}'" for a, b in S.WHOLE.items())
    parts.append(f"stems as (select word, case word {whole} else case when length(word) <= 2 then word when done then regexp_replace(word, 's$', '') "
                 f"else replace(w, 'Y', 'y') end end stem from s_{len(steps)})")
    return ",\n".join(parts)


@query("lexeme_stems", f"with {POSTINGS_SQL}, {stems_sql('posted')} select word lexeme, stem from stems")
def lexeme_stems(spark, d):
    return S.stems(lexical.postings(document_chunks(spark, d), stemmed=False))


STEMMED_SQL = POSTINGS_SQL.replace("occurrences as (", "plain_occurrences as (").replace("posted as (", f"""{stems_sql('plain_occurrences')},
occurrences as (select chunk_id, stem lexeme, pos, tag from plain_occurrences join stems on word = lexeme),
posted as (""")


@query("postings_stemmed", f"with {STEMMED_SQL} select lexeme, chunk_id, n_a, n_b from posted")
def postings_stemmed(spark, d):
    return lexical.postings(document_chunks(spark, d)).select("lexeme", "chunk_id", "n_a", "n_b")


QUERY_STEMS_SQL = re.sub(r"\bs_(?=words|first|\d)", "q_", stems_sql("plain_terms")).replace("stems as", "query_stems as")
STEMMED_TERMS_SQL = terms_sql(BENCHMARK_SOURCE).replace("terms as (", "plain_terms as (", 1).replace("sizes as (", f"""{QUERY_STEMS_SQL},
terms as (select p.* replace (stem as lexeme) from plain_terms p join query_stems on word = lexeme),
sizes as (""", 1)


@query("lexical_topk_stemmed", f"with {STEMMED_SQL}, {STEMMED_TERMS_SQL}, {TF_SQL.format(k=K)}{LEXICAL_OUT}")
def lexical_topk_stemmed(spark, d):
    out = lexical.lexical_topk(benchmark_queries(spark, d), lexical.postings(document_chunks(spark, d)), K, "tf_weighted")
    return out.withColumn("lexical_score", F.round("lexical_score", 6))
