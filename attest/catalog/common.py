"""Tables derived from the given ones, and the same derivations in SQL."""
from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C
from ..functions import text as X
from ..operators import lexical, normalise
from ..session import checkpoint_folder, materialise
from ..sources.postings_index import PostingsIndex

# SQL spellings of the text classes.
SQL_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SQL_WORD = r"[\p{L}\p{N}_]+"
SQL_TOKEN = (r"[\p{L}\p{N}_]+(?:[''’-][\p{L}\p{N}_]+)?|"
             r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
SQL_STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SQL_SPACE}+', ' ', 'g'))"


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_tokens(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{SQL_TOKEN}'))"


def sql_words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{SQL_WORD}')"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def table_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    # A stream reads folders or patterns, so the table's own name is written as a pattern.
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


_stored: dict[tuple, object] = {}


def once(build: Callable) -> Callable:
    """What `build` stores for a session and a folder of tables is built once and then read by all queries that need it."""
    @wraps(build)
    def get(spark: SparkSession, d: str):
        key = (build.__module__, build.__name__, spark.sparkContext.applicationId, d)
        if key not in _stored:
            _stored[key] = build(spark, d)
        return _stored[key]

    return get


# --- documents as one-page sources ------------------------------------------------------------

# Headings of the documents: a one-word line opens a part, another short line a section.
PART, SECTION = r"^(\S{2,14}\.)$", r"^(\S.{0,40})$"
REPEATED = (r"^Of\.$", r"^Ietzte\.$", r"^And ornd\.$")
DOCUMENT_RULES = C.PageRules(repeated_lines=REPEATED, part_patterns=(PART,), section_patterns=(SECTION,))


def document_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("document_id"), F.col("source").alias("source_id"),
        X.sha256_tag(F.col("text")).alias("source_hash"), F.lit(1).alias("page_number"), "text")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return normalise.page_lines(document_pages(spark, d), {}, DOCUMENT_RULES)


def document_blocks(spark: SparkSession, d: str) -> DataFrame:
    return normalise.page_blocks(document_lines(spark, d))


_REPEATED_SQL = "(?i)" + "|".join(f"(?:{p})" for p in REPEATED)
_NUMBERED = r"^(\d+(?:\.\d+){1,4})\s+(.+)$"
LINES_SQL = rf"""
parts as (
  select doc_id, source, regexp_split_to_array(text, '{SQL_BREAK}') a from documents),
cut as (select doc_id, source, case when a[-1] = '' then a[:-2] else a end a from parts),
raw_lines as (
  select 'd' || doc_id document_id, source source_id, unnest(a) raw, generate_subscripts(a, 1) - 1 line_no from cut),
clean_lines as (select document_id, source_id, line_no, {sql_collapse('raw')} line from raw_lines),
lines as (
  select *, case
    when line = '' then 'blank'
    when regexp_matches(line, '{_REPEATED_SQL}') then 'boilerplate'
    when level is not null then 'heading' else 'text' end kind
  from (
    select *, case
      when regexp_matches(line, '(?i){PART}') then 1
      when regexp_matches(line, '(?i){SECTION}') then 2
      when regexp_matches(line, '{_NUMBERED}')
        then 3 + length(regexp_extract(line, '{_NUMBERED}', 1)) - length(replace(regexp_extract(line, '{_NUMBERED}', 1), '.', ''))
    end level from clean_lines))
"""


def _latest(k: int) -> str:
    w = "over (partition by document_id order by island)"
    return f"max(case when level = {k} then island end) {w} p{k}"


def _open(k: int) -> str:
    above = " and ".join([f"p{k} > coalesce(p{j}, -1)" for j in range(1, k)] or ["true"])
    return f"case when p{k} is not null and {above} then (select h.text from heads h where h.document_id = b.document_id and h.island = b.p{k}) end"


LEVELS = range(1, 8)
BLOCKS_SQL = LINES_SQL + rf""",
kept as (
  select *, lag(kind) over (partition by document_id order by line_no) before
  from lines where kind <> 'boilerplate'),
numbered as (
  select *, sum(case when kind = 'heading' or (kind = 'text' and coalesce(before, '') <> 'text') then 1 else 0 end)
    over (partition by document_id order by line_no) island from kept),
joined as (
  select document_id, source_id, island, max(level) filter (kind = 'heading') level,
    string_agg(line, ' ' order by line_no) as text
  from numbered where kind <> 'blank' group by all),
heads as (select document_id, island, case when level = 1 and upper(text) = text and lower(text) <> text
    then upper(text[1]) || lower(text[2:]) else text end as text from joined where level is not null),
placed as (select *, row_number() over (partition by document_id order by island) ordinal,
    {', '.join(_latest(k) for k in LEVELS)} from joined),
blocks as (
  select b.document_id || ':p001:b' || lpad(ordinal::varchar, 4, '0') block_id, b.document_id, b.source_id, ordinal,
    case when level is not null then 'heading'
      when regexp_matches(text, '^[•–-]') or regexp_matches(text, '(?i)^(?:\d+\.|[a-z]\)|[A-Z]\)|[ivxlcdm]+\))\s+') then 'list_item'
      when starts_with(lower(text), 'table ') then 'table' else 'paragraph' end block_type,
    case when level is not null then (select h.text from heads h where h.document_id = b.document_id and h.island = b.island)
      else text end as text, level,
    list_filter([{', '.join(_open(k) for k in LEVELS)}], lambda x: x is not null) path
  from placed b)
"""


# --- documents as search units ----------------------------------------------------------------


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as chunks with citation attributes derived from their columns."""
    rows = table(spark, d, "documents")
    citation = normalise.citation_of(
        pdf_page_start=(F.col("n_chars") % 40).cast("int"),
        section_ids=F.array(F.col("lang"), F.concat(F.lit("s"), (F.col("n_chars") % 7).cast("string"))))
    policy = F.struct(
        F.concat(F.lit("tier_"), (F.col("doc_id") % 3).cast("string")).alias("authority_tier"),
        F.lit("default_current").alias("retrieval_tier"), F.lit("current_candidate").alias("currency_status"))
    types = F.when(F.col("n_chars") % 2 == 0, F.array(F.lit("heading"), F.lit("paragraph"))).otherwise(
        F.array(F.lit("list_item")))
    return rows.select(
        F.col("doc_id").alias("chunk_id"), F.concat(F.lit("d"), F.col("doc_id")).alias("document_id"),
        F.col("source").alias("source_id"), F.array(F.col("source"), F.col("lang")).alias("heading_path"),
        F.col("text").alias("evidence_text"), citation.alias("citation"), types.alias("block_types"),
        policy.alias("source_policy"))


CHUNKS_SQL = """
docs as (
  select doc_id chunk_id, 'd' || doc_id document_id, source source_id, [source, lang] heading_path, text evidence_text,
    (n_chars % 40)::int page, [lang, 's' || (n_chars % 7)] sections,
    case when n_chars % 2 = 0 then ['heading', 'paragraph'] else ['list_item'] end types,
    'tier_' || (doc_id % 3) tier
  from documents)
"""


def benchmark_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def gold_queries(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items with the metadata of the document of the same number as gold."""
    gold = document_chunks(spark, d).select(
        F.col("chunk_id").alias("query_id"),
        F.struct("source_id", "document_id", "heading_path", "citation", "block_types", "source_policy").alias("gold_metadata"))
    return benchmark_queries(spark, d).join(gold, "query_id")


def vector_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("source_id"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vector of the same number stands for each benchmark item."""
    return vector_table(spark, d).join(
        table(spark, d, "benchmark").select(F.col("item_id").alias("chunk_id")), "chunk_id"
    ).select(F.col("chunk_id").alias("query_id"), "embedding")


@once
def document_postings(spark: SparkSession, d: str) -> DataFrame:
    """The postings of all documents, unstemmed, as a stored table: the corpus is cut into words once."""
    return materialise(lexical.postings(document_chunks(spark, d), stemmed=False), "postings")


@once
def document_index(spark: SparkSession, d: str) -> PostingsIndex:
    """A stored index of all documents, unstemmed, in two generations.

    The second one brings the documents that the first left out, and again those that it held without their headings.
    """
    rows, n = document_chunks(spark, d), F.col("chunk_id")
    index = PostingsIndex(spark, f"{checkpoint_folder(spark)}/attest/index-{uuid.uuid4().hex}", parts=8, window=64, stemmed=False)
    stale = F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("heading_path"))
    index.add(rows.where(n % 3 != 0).withColumn("heading_path", stale))
    index.add(rows.where((n % 3 == 0) | (n % 5 == 0)))
    return index
