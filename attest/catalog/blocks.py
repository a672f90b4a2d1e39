"""Lines, blocks, chunks and their gates over documents and pages."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X
from ..operators import chunk, html, normalise, ordered, quality
from ..session import materialise
from . import query
from .common import (BLOCKS_SQL, DOCUMENT_RULES, LINES_SQL, document_blocks, document_lines, document_pages,
                     sql_collapse, sql_tokens, table)


@query("whitespace_normalised", f"select doc_id, {sql_collapse('text')} as clean_text from documents")
def whitespace_normalised(spark, d):
    return table(spark, d, "documents").select("doc_id", X.collapse(F.col("text")).alias("clean_text"))


@query("doc_token_counts", f"""
select doc_id, {sql_tokens('text')}::int n_tokens,
  case when {sql_collapse('text')} = '' then 0 else len(string_split({sql_collapse('text')}, ' ')) end::int n_words
from documents""")
def doc_token_counts(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.token_count(F.col("text")).alias("n_tokens"), X.word_count(F.col("text")).cast("int").alias("n_words"))


@query("content_hashes", "select doc_id, 'sha256:' || sha256(text) content_hash from documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sha256_tag(F.col("text")).alias("content_hash"))


@query("document_lines", f"""with {LINES_SQL}
select document_id, line_no::int line_no, kind, case when kind = 'heading' then level end::int as "level", line from lines""")
def document_line_table(spark, d):
    return document_lines(spark, d).select("document_id", "line_no", "kind", F.col("found.level").alias("level"), "line")


@query("boilerplate_removed", f"""with {LINES_SQL}
select source_id, kind, count(*) n from lines group by all""")
def boilerplate_removed(spark, d):
    return document_lines(spark, d).groupBy("source_id", "kind").agg(F.count("*").alias("n"))


@query("adjacent_dedup", f"""with {LINES_SQL},
marked as (
  select document_id, lag(line) over (partition by document_id order by line_no) is not distinct from line same
  from lines where line <> '')
select document_id, count(*) filter (not same) kept, count(*) filter (same) suppressed from marked group by 1""")
def adjacent_dedup(spark, d):
    rows = document_lines(spark, d).where("line <> ''").withColumn("place", ordered.segment_of(F.col("line_no"), 64))
    marked = ordered.dedup_adjacent(rows.select("document_id", "place", "line_no", "line"), ["document_id"], "place", ["line_no"], ["line"])
    return marked.groupBy("document_id").agg(
        F.count_if(~F.col("is_repeat")).alias("kept"), F.count_if(F.col("is_repeat")).alias("suppressed"))


@query("heading_paths", f"""with {LINES_SQL},
leveled as (
  select document_id, line_no, line, case when line_no = 0 then 1 when length(line) <= 40 then 2 when length(line) <= 120 then 3 end lv
  from lines where line <> ''),
latest as (
  select *, {', '.join(
    f"max(case when lv = {k} then line_no end) over w p{k}, "
    f"max_by(case when lv = {k} then line end, case when lv = {k} then line_no end) over w h{k}" for k in (1, 2, 3))}
  from leveled window w as (partition by document_id order by line_no))
select document_id, line_no::int line_no, concat_ws(' > ', h1, case when p2 > coalesce(p1, -1) then h2 end,
  case when p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) then h3 end) heading_path
from latest""")
def heading_paths(spark, d):
    size = F.length("line")
    level = F.when(F.col("line_no") == 0, 1).when(size <= 40, 2).when(size <= 120, 3)
    rows = document_lines(spark, d).where("line <> ''").select(
        "document_id", "line_no", "line", level.alias("level"), ordered.segment_of(F.col("line_no"), 32).alias("place"))
    out = ordered.heading_stack(rows, ["document_id"], "place", ["line_no"], "level", F.col("line"), max_level=3)
    return out.select("document_id", "line_no", X.join_path(F.col("heading_path")).alias("heading_path"))


@query("line_blocks", f"""with {BLOCKS_SQL}
select block_id, ordinal, block_type, text as "text", array_to_string(path, ' > ') heading_path,
  level::int heading_level, block_type <> 'heading' and len(path) = 0 flagged
from blocks""")
def line_blocks(spark, d):
    return document_blocks(spark, d).select(
        "block_id", "ordinal", "block_type", "text", X.join_path(F.col("heading_path")).alias("heading_path"), "heading_level",
        (F.size("normalisation_flags") > 0).alias("flagged"))


@query("block_type_counts", f"""with {BLOCKS_SQL}
select document_id, block_type, count(*) n from blocks group by all""")
def block_type_counts(spark, d):
    counts = quality.block_type_counts(document_blocks(spark, d))
    return counts.select("document_id", F.explode("block_types").alias("block_type", "n"))


@query("normalisation_summary", f"""with {BLOCKS_SQL},
b as (select document_id, count(*) output_blocks, count(*) filter (block_type <> 'heading' and len(path) = 0)
    blocks_flagged_for_review from blocks group by 1),
l as (select document_id, count(*) filter (kind = 'boilerplate') boilerplate_lines_removed from lines group by 1)
select 'd' || doc_id document_id, 1 input_pages, 0 contents_pages_skipped, coalesce(output_blocks, 0) output_blocks,
  coalesce(blocks_flagged_for_review, 0) blocks_flagged_for_review, coalesce(boilerplate_lines_removed, 0) boilerplate_lines_removed
from documents left join b on b.document_id = 'd' || doc_id left join l on l.document_id = 'd' || doc_id""")
def normalisation_summary(spark, d):
    return normalise.page_summary(document_pages(spark, d), {}, DOCUMENT_RULES)


def _document_rows(spark, d):
    """Documents of known and unknown hash, as the gates read them."""
    labels = table(spark, d, "labels").select("doc_id", F.lit(True).alias("labelled"))
    return table(spark, d, "documents").join(labels, "doc_id", "left").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("document_id"), F.lit("pdf").alias("source_type"),
        F.when(F.col("n_chars") >= 20, C.SCHEMA_VERSION).alias("schema_version"),
        F.when(F.col("labelled"), X.sha256_tag(F.col("text"))).alias("content_hash"), F.col("source").alias("source_id"))


@query("block_quality_status", f"""with {BLOCKS_SQL},
v as (
  select document_id, 0 e, 1 w from blocks where len(path) = 0
  union all select 'd' || doc_id, 1, 0 from documents where n_chars < 20
  union all select 'd' || doc_id, 0, 1 from documents where doc_id not in (select doc_id from labels)),
t as (select document_id, sum(e)::bigint errors, sum(w)::bigint warnings from v group by 1)
select 'd' || doc_id document_id, coalesce(errors, 0) errors, coalesce(warnings, 0) warnings,
  case when errors > 0 then 'fail' when warnings > 0 then 'review' else 'pass' end status
from documents left join t on t.document_id = 'd' || doc_id""")
def block_quality_status(spark, d):
    documents = _document_rows(spark, d)
    return quality.document_status(quality.check_blocks(document_blocks(spark, d), documents), documents)


@query("corpus_quality_report", f"""with {BLOCKS_SQL},
bad as (select distinct 'd' || doc_id document_id from documents where n_chars < 20),
warn as (select document_id from blocks where len(path) = 0
  union select 'd' || doc_id from documents where doc_id not in (select doc_id from labels)),
s as (select case when b.document_id is not null then 'fail' when w.document_id is not null then 'review' else 'pass' end status
  from documents left join bad b on b.document_id = 'd' || doc_id left join warn w on w.document_id = 'd' || doc_id)
select count(*) documents, count(*) filter (status = 'pass') pass, count(*) filter (status = 'review') review,
  count(*) filter (status = 'fail') fail from s""")
def corpus_quality_report(spark, d):
    return quality.corpus_report(block_quality_status(spark, d))


@query("block_counters", f"""with {BLOCKS_SQL},
c as (
  select document_id, len(string_split(text, ' ')) n_words,
    (lag(block_type) over w is not distinct from block_type and lag(text) over w is not distinct from text
      and lag(path) over w is not distinct from path) same
  from blocks window w as (partition by document_id order by ordinal))
select document_id, count(*) block_count, count(*) filter (n_words between 1 and 4) short_substantive_blocks,
  count(*) filter (n_words > 1200) oversized_blocks, count(*) filter (same) adjacent_duplicate_blocks
from c group by 1""")
def block_counters(spark, d):
    return quality.block_counters(document_blocks(spark, d))


CHUNK_SQL = BLOCKS_SQL.replace("with ", "", 1) + f""",
sized as (
  select *, block_type = 'heading' h, block_type = 'table' t, {sql_tokens('text')} tok, count(*) over (partition by document_id) n_all
  from blocks),
prefixed as (
  select *, sum(tok) over w s, sum(case when h then 0 else 1 end) over w nh
  from sized window w as (partition by document_id order by ordinal)),
stops as (
  select i.document_id, i.ordinal start, min(case
    when j.h and j.path <> i.path and (j.nh - (case when j.h then 0 else 1 end)) - (i.nh - (case when i.h then 0 else 1 end)) > 0 then j.ordinal
    when j.s - i.s + i.tok > 500 then j.ordinal
    when j.t then j.ordinal + case when j.s - i.s + i.tok <= 750 then 1 else 0 end end) stop
  from prefixed i left join prefixed j on j.document_id = i.document_id and j.ordinal > i.ordinal
  group by all),
nexts as (
  select p.document_id, p.ordinal start, case when p.t then p.ordinal + 1 else coalesce(x.stop, n_all + 1) end stop
  from prefixed p join stops x on x.document_id = p.document_id and x.start = p.ordinal),
chain as (
  select document_id, start, stop from nexts where start = 1
  union all
  select n.document_id, n.start, n.stop from chain c join nexts n on n.document_id = c.document_id and n.start = c.stop),
members as (
  select c.document_id, dense_rank() over (partition by c.document_id order by c.start) chunk_ordinal, b.*
  exclude (document_id) from chain c join prefixed b on b.document_id = c.document_id and b.ordinal >= c.start and b.ordinal < c.stop),
chunked as (
  select document_id, chunk_ordinal, any_value(source_id) source_id, list(block_id order by ordinal) block_ids,
    string_agg(text, chr(10) || chr(10) order by ordinal) evidence_text,
    coalesce(min_by(array_to_string(path, ' > '), ordinal) filter (not h), max_by(array_to_string(path, ' > '), ordinal)) heading_path,
    max(chunk_ordinal) over (partition by document_id) last_ordinal
  from members group by document_id, chunk_ordinal),
chunk_rows as (
  select *, document_id || ':c' || lpad(chunk_ordinal::varchar, 4, '0') chunk_id, {sql_tokens('evidence_text')} n_tokens
  from chunked)
"""


def document_chunk_table(spark, d):
    blocks = materialise(document_blocks(spark, d), "blocks")
    return chunk.chunks(blocks)


@query("chunks", f"""with recursive {CHUNK_SQL}
select chunk_id, source_id, len(block_ids) n_blocks, block_ids[1] first_block, heading_path,
  'sha256:' || sha256(evidence_text) evidence_text_sha256, n_tokens::int estimated_evidence_tokens,
  {sql_tokens('''('title: ' || document_id || ' | text: ' || case when heading_path <> '' then
    'Section: ' || heading_path || chr(10) || chr(10) else '' end || evidence_text)''')}::int estimated_embedding_tokens,
  case when chunk_ordinal > 1 then document_id || ':c' || lpad((chunk_ordinal - 1)::varchar, 4, '0') end previous_chunk_id,
  case when chunk_ordinal < last_ordinal then document_id || ':c' || lpad((chunk_ordinal + 1)::varchar, 4, '0') end next_chunk_id,
  n_tokens > 750 over_limit
from chunk_rows""")
def chunks(spark, d):
    return document_chunk_table(spark, d).select(
        "chunk_id", "source_id", F.size("block_ids").cast("long").alias("n_blocks"), F.col("block_ids")[0].alias("first_block"),
        X.join_path(F.col("heading_path")).alias("heading_path"), "evidence_text_sha256", "estimated_evidence_tokens",
        "estimated_embedding_tokens", "previous_chunk_id", "next_chunk_id", (F.size("chunking_flags") > 0).alias("over_limit"))


# A hard limit below the soft one: most chunks are split, and parts overlap by forty tokens.
SPLIT_LIMITS = C.ChunkLimits(soft=500, hard=150, overlap=40)
SPLIT_SQL = CHUNK_SQL[:CHUNK_SQL.index("chunked as (")].replace("<= 750", "<= 150") + f"""
sums as (
  select document_id, chunk_ordinal, 0 i, 0::hugeint s from members group by all
  union all select document_id, chunk_ordinal, row_number() over w, sum(tok) over w from members window w as (partition by document_id, chunk_ordinal order by ordinal)),
sizes as (select document_id, chunk_ordinal, max(i) n from sums group by all),
fits as (select a.document_id, a.chunk_ordinal, a.i, max(b.i) fit from sums a join sums b using (document_id, chunk_ordinal) where b.s <= a.s + 150 group by all),
backs as (select a.document_id, a.chunk_ordinal, a.i, min(b.i) back from sums a join sums b using (document_id, chunk_ordinal) where b.s >= a.s - 40 group by all),
split_parts as (
  select document_id, chunk_ordinal, 0 part, 0::bigint f, least(n, greatest(1, fit)) e from fits join sizes using (document_id, chunk_ordinal) where i = 0
  union all
  select p.document_id, p.chunk_ordinal, part + 1, f2, least(n, greatest(e + 1, x.fit)) from (
    select p.*, n, greatest(f, least(e - 1, back)) f2 from split_parts p join sizes using (document_id, chunk_ordinal)
    join backs b on b.document_id = p.document_id and b.chunk_ordinal = p.chunk_ordinal and b.i = p.e where p.e < n) p
  join fits x on x.document_id = p.document_id and x.chunk_ordinal = p.chunk_ordinal and x.i = f2),
placed_members as (select *, row_number() over (partition by document_id, chunk_ordinal order by ordinal) - 1 i from members),
part_blocks as (
  select p.document_id, p.chunk_ordinal, p.part, m.ordinal, m.block_id, m.text, dense_rank() over (partition by p.document_id order by p.chunk_ordinal, p.part) number
  from split_parts p join placed_members m on m.document_id = p.document_id and m.chunk_ordinal = p.chunk_ordinal and m.i >= p.f and m.i < p.e),
part_sections as (
  select document_id, number, string_agg(section, ',' order by first_at) sections from (
    select document_id, number, 's' || ordinal % 3 section, min(ordinal) first_at from part_blocks group by all) group by all),
part_rows as (
  select document_id, number, count(*) n_blocks, min_by(block_id, ordinal) first_block, max_by(block_id, ordinal) last_block,
    string_agg(text, chr(10) || chr(10) order by ordinal) evidence_text, min(ordinal) first_ordinal, max(ordinal) last_ordinal from part_blocks group by all)"""


def split_chunk_table(spark, d):
    """Chunks of all documents under a hard limit below the soft one, with pages and sections that follow the blocks."""
    n = F.col("ordinal").cast("int")
    cited = normalise.citation_of(pdf_page_start=n, pdf_page_end=F.when(n % 2 == 0, n + 1), section_ids=F.array(F.concat(F.lit("s"), (n % 3).cast("string"))))
    return chunk.chunks(materialise(document_blocks(spark, d).withColumn("citation", cited), "blocks"), limits=SPLIT_LIMITS)


@query("split_chunks", f"""with recursive {SPLIT_SQL}
select document_id || ':c' || lpad(number::varchar, 4, '0') chunk_id, n_blocks, first_block, last_block, 'sha256:' || sha256(evidence_text) evidence_text_sha256,
  {sql_tokens('evidence_text')}::int estimated_evidence_tokens, {sql_tokens('evidence_text')} > 150 over_limit, first_ordinal::int page_start,
  coalesce(case when last_ordinal % 2 = 0 then last_ordinal + 1 end, case when first_ordinal % 2 = 0 then first_ordinal + 1 end)::int page_end, sections
from part_rows join part_sections using (document_id, number)""")
def split_chunks(spark, d):
    """Parts of chunks above the hard limit, their overlap and their merged citations."""
    return split_chunk_table(spark, d).select(
        "chunk_id", F.size("block_ids").cast("long").alias("n_blocks"), F.col("block_ids")[0].alias("first_block"), F.element_at("block_ids", -1).alias("last_block"),
        "evidence_text_sha256", "estimated_evidence_tokens", (F.size("chunking_flags") > 0).alias("over_limit"), F.col("citation.pdf_page_start").alias("page_start"),
        F.col("citation.pdf_page_end").alias("page_end"), F.array_join("citation.section_ids", ",").alias("sections"))


# --- rows on which the rules of the gates fire ------------------------------------------------


def _rules_sql(rows: str, subject: str, rules: list[tuple[str, str, str]]) -> str:
    return " union all ".join(f"select document_id, '{severity}' severity, {subject} || ': {message}' message from {rows} where {hit}" for severity, hit, message in rules)


BAD_BLOCKS_SQL = BLOCKS_SQL.replace("with ", "", 1) + """,
bad_documents as (
  select 'd' || doc_id document_id, case when doc_id % 2 = 0 then 'pdf' else 'html' end source_type, doc_id % 3 = 0 no_version, doc_id % 5 = 0 no_hash from documents)"""


@query("block_violations", f"with {BAD_BLOCKS_SQL}, b as (select * from blocks join bad_documents using (document_id)) " + _rules_sql("b", "block_id", [
    ("error", "ordinal % 5 = 0", "missing source_id"), ("error", "ordinal % 7 = 0", "empty text"), ("warning", "ordinal % 6 <> 0 and ordinal % 4 = 0", "no heading path"),
    ("error", "source_type = ''pdf'' and ordinal % 6 <> 0 and ordinal % 3 = 0".replace("''", "'"), "PDF block missing pdf_page_start"),
    ("error", "source_type = ''html'' and ordinal % 6 <> 0 and ordinal % 2 = 0".replace("''", "'"), "HTML block missing heading-path citation")]) + " union all " + _rules_sql(
    "bad_documents", "'document'", [("error", "no_version", "missing schema_version"), ("warning", "no_hash", "missing source content hash")]))
def block_violations(spark, d):
    """All blocks with defects by place: every rule of the block gate fires."""
    n, k = F.col("ordinal"), F.col("doc_id")
    path = F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A part")))
    cited = normalise.citation_of(pdf_page_start=F.when(n % 3 != 0, F.lit(1)), heading_path=F.when(n % 2 != 0, F.array(F.lit("A part"))))
    blocks = document_blocks(spark, d).withColumns({
        "source_id": F.when(n % 5 != 0, F.col("source_id")), "text": F.when(n % 7 != 0, F.col("text")), "heading_path": path, "citation": cited, "is_substantive": n % 6 != 0})
    documents = table(spark, d, "documents").select(
        F.concat(F.lit("d"), k).alias("document_id"), F.when(k % 2 == 0, "pdf").otherwise("html").alias("source_type"),
        F.when(k % 3 != 0, "1.0").alias("schema_version"), F.when(k % 5 != 0, "sha256:0").alias("content_hash"))
    return quality.check_blocks(blocks, documents)


@query("chunk_violations", f"""with recursive {CHUNK_SQL},
c as (select *, doc.source source_of from chunk_rows join (select 'd' || doc_id document_id, doc_id, source from documents) doc using (document_id)) """ + _rules_sql("c", "chunk_id", [
    ("error", "chunk_ordinal % 5 = 0", "empty evidence_text"), ("error", "chunk_ordinal % 6 = 0", "empty embedding_text"), ("error", "chunk_ordinal % 7 = 0", "no block_ids"),
    ("error", "doc_id % 4 = 0", "source_id does not match document source"), ("error", "chunk_ordinal % 3 = 0", "missing citation"),
    ("warning", "n_tokens > 300", "exceeds hard token target"), ("error", "chunk_ordinal > 1 and chunk_ordinal % 4 = 0", "invalid previous_chunk_id"),
    ("error", "chunk_ordinal < last_ordinal and chunk_ordinal % 4 = 1", "invalid next_chunk_id")]))
def chunk_violations(spark, d):
    """All chunks with defects by place: every rule of the chunk gate fires."""
    n, k = F.col("chunk_ordinal"), F.col("doc_id")
    rows = document_chunk_table(spark, d).withColumns({
        "evidence_text": F.when(n % 5 != 0, F.col("evidence_text")), "embedding_text": F.when(n % 6 != 0, F.col("embedding_text")),
        "block_ids": F.when(n % 7 != 0, F.col("block_ids")), "citation": F.when(n % 3 != 0, F.col("citation")),
        "previous_chunk_id": F.when(n % 4 == 0, F.lit("wrong")).otherwise(F.col("previous_chunk_id")),
        "next_chunk_id": F.when(n % 4 == 1, F.lit("wrong")).otherwise(F.col("next_chunk_id"))})
    documents = table(spark, d, "documents").select(F.concat(F.lit("d"), k).alias("document_id"), F.when(k % 4 == 0, "other").otherwise(F.col("source")).alias("source_id"))
    return quality.check_chunks(rows, documents, hard=300)


@query("chunk_summary", f"""with recursive {CHUNK_SQL}
select b.document_id, input_blocks, output_chunks, false historical_only, chunks_over_hard_limit
from (select document_id, count(*) input_blocks from blocks group by 1) b
left join (select document_id, count(*) output_chunks, count(*) filter (n_tokens > 750) chunks_over_hard_limit
  from chunk_rows group by 1) c using (document_id)""")
def chunk_summary(spark, d):
    blocks = materialise(document_blocks(spark, d), "blocks")
    return chunk.chunk_summary(blocks, chunk.chunks(blocks))


@query("chunk_quality", f"""with recursive {CHUNK_SQL},
w as (select document_id, count(*) n from chunk_rows where n_tokens > 750 group by 1)
select 'd' || doc_id document_id, 0::bigint errors, coalesce(n, 0) warnings, case when n > 0 then 'review' else 'pass' end status
from documents left join w on w.document_id = 'd' || doc_id""")
def chunk_quality(spark, d):
    documents = _document_rows(spark, d)
    found = quality.check_chunks(document_chunk_table(spark, d), documents)
    return quality.document_status(found, documents)


@query("missing_policy", """
select 'd' || doc_id document_id, source source_id, 'Missing source policy for ' || source as "error"
from documents where source not in ('src0', 'src1', 'src2', 'src3') and length(trim(text)) > 0""")
def missing_policy(spark, d):
    from ..sources.readers import policy_table

    policies = policy_table(spark, {f"src{i}": {"authority_tier": "primary"} for i in range(4)})
    blocks = table(spark, d, "documents").where(~X.is_blank(F.col("text"))).select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("document_id"), F.col("source").alias("source_id"))
    return chunk.missing_policy(blocks, policies)


# --- html -------------------------------------------------------------------------------------

# In these pages the article has one heading; all that follows it, up to the footer, is text of one
# paragraph that is never closed. Tags part words; entities stand for their characters.


def sql_unescape(c: str) -> str:
    """Named characters, with or without their closing mark, as browsers read them."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        c = f"regexp_replace({c}, '&{name};?', '{char}', 'g')"
    return c


def sql_visible(c: str) -> str:
    return sql_collapse(sql_unescape(f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"))


HTML_SQL = rf"""
cut as (
  select page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) h1, regexp_extract(html, '(?s)</h1>(.*)$', 1) tail from pages),
pieces as (
  select page_id, {sql_visible('h1')} heading, {sql_visible("regexp_replace(tail, '(?s)<footer>.*$', '')")} para from cut),
html_rows as (
  select page_id, 1 seq, 'heading' block_type, 1 heading_level, heading, heading as heading_path, heading as text from pieces where heading <> ''
  union all
  select page_id, case when heading = '' then 1 else 2 end, 'paragraph', null, null, heading, para from pieces where para <> '')
"""


@query("html_blocks", f"with {HTML_SQL} select page_id, seq, block_type, heading_level, heading, heading_path, text as \"text\" from html_rows")
def html_block_table(spark, d):
    return html.html_blocks(table(spark, d, "pages"))


@query("html_structured_text", f"""with {HTML_SQL}
select page_id, string_agg(case when block_type = 'heading' then '--- H1: ' || heading || ' ---' else text end, chr(10) || chr(10) order by seq) structured_text
from html_rows group by 1""")
def html_structured_text(spark, d):
    return html.structured_html(html.html_blocks(table(spark, d, "pages")))


def raw_html(spark, d):
    return html.html_blocks(table(spark, d, "pages")).select(
        F.concat(F.lit("w"), "page_id").alias("document_id"), F.lit("web").alias("source_id"), F.lit(None).cast("string").alias("source_hash"),
        "seq", "block_type", "heading_level", "heading", "heading_path", "text")


@query("html_normalised", f"""with {HTML_SQL}
select 'w' || page_id || ':b' || lpad(seq::varchar, 4, '0') block_id, 'w' || page_id document_id, seq ordinal, block_type, text as "text",
  heading_path, heading_level from html_rows""")
def html_normalised(spark, d):
    return normalise.normalise_html(raw_html(spark, d)).select(
        "block_id", "document_id", "ordinal", "block_type", "text", X.join_path(F.col("heading_path")).alias("heading_path"), "heading_level")


@query("html_summary", f"""with {HTML_SQL}
select 'w' || page_id document_id, count(*) input_blocks, count(*) output_blocks, 0 adjacent_duplicates_suppressed, 0 blocks_flagged_for_review
from html_rows group by 1""")
def html_summary(spark, d):
    return normalise.html_summary(raw_html(spark, d))


@query("structured_pages", "select 'd' || doc_id document_id, '--- PAGE 1 ---' || chr(10) || text as structured_text from documents")
def structured_pages(spark, d):
    return html.structured_pages(document_pages(spark, d))


@query("structured_many_pages", """
with p as (select 'stream' || user_id % 2 document_id, row_number() over (partition by user_id % 2 order by event_id) n, event_type t from events)
select document_id, string_agg('--- PAGE ' || n || ' ---' || chr(10) || t, chr(10) || chr(10) order by n) structured_text from p group by 1""")
def structured_many_pages(spark, d):
    """Events as the pages of two documents, thousands of pages each."""
    group = F.col("user_id") % 2
    numbered = ordered.scan(
        table(spark, d, "events").select(F.concat(F.lit("stream"), group).alias("document_id"), "event_id", F.col("event_type").alias("text"),
                                         ordered.segment_of(F.col("event_id"), 1024).alias("place")),
        ["document_id"], "place", ["event_id"], sums={"page_number": F.lit(1)})
    return html.structured_pages(numbered)


PAGES_SQL = """
events_pages as (select 'u' || user_id % 7 document_id, row_number() over (partition by user_id % 7 order by event_id) n, event_type || repeat(' ' || event_type, (event_id % 23)::int) t from events),
pieces as (select *, case when n > 1 then chr(10) || chr(10) else '' end || '--- PAGE ' || n || ' ---' || chr(10) || t piece from events_pages),
placed as (select *, sum(length(piece)) over (partition by document_id order by n) - length(piece) start from pieces)"""


def _event_pages(spark, d):
    """Events as the pages of seven documents, which grow with the table."""
    text = F.concat("event_type", F.repeat(F.concat(F.lit(" "), "event_type"), (F.col("event_id") % 23).cast("int")))
    return ordered.scan(
        table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") % 7).alias("document_id"), "event_id", text.alias("text"),
                                         ordered.segment_of(F.col("event_id"), 1024).alias("place")),
        ["document_id"], "place", ["event_id"], sums={"page_number": F.lit(1)})


@query("structured_parts", f"""with {PAGES_SQL}
select document_id, (start // 2000)::int part, min(start)::bigint start, count(*) n_pages, sha256(string_agg(piece, '' order by n)) text_sha256 from placed group by all""")
def structured_parts(spark, d):
    """Long documents as ordered parts of some 2,000 characters with their places."""
    out = html.structured_parts(_event_pages(spark, d), 2000)
    return out.select("document_id", "part", "start", "n_pages", F.sha2("text", 256).alias("text_sha256"))


DEEP_LEVEL = "case when line_no = 0 then 1 else 1 + (line_no * 7 + length(line)) % 9 end"


@query("deep_heading_paths", f"""with {LINES_SQL},
leveled as (select document_id, line_no, line, {DEEP_LEVEL} lv from lines where line <> ''),
latest as (
  select *, {', '.join(
    f"max(case when lv = {k} then line_no end) over w p{k}, "
    f"max_by(case when lv = {k} then line end, case when lv = {k} then line_no end) over w h{k}" for k in range(1, 10))}
  from leveled window w as (partition by document_id order by line_no))
select document_id, line_no::int line_no, concat_ws(' > ', {', '.join(
    f"case when p{k} > greatest(-1{''.join(f', coalesce(p{j}, -1)' for j in range(1, k))}) then h{k} end" for k in range(1, 10))}) heading_path
from latest""")
def deep_heading_paths(spark, d):
    """Paths of nine levels."""
    level = F.when(F.col("line_no") == 0, 1).otherwise(1 + (F.col("line_no") * 7 + F.length("line")) % 9)
    rows = document_lines(spark, d).where("line <> ''").select(
        "document_id", "line_no", "line", level.cast("int").alias("level"), ordered.segment_of(F.col("line_no"), 32).alias("place"))
    out = ordered.heading_stack(rows, ["document_id"], "place", ["line_no"], "level", F.col("line"), max_level=9)
    return out.select("document_id", "line_no", X.join_path(F.col("heading_path")).alias("heading_path"))


@query("document_routes", """
select 'd' || doc_id document_id, case when lang = 'en' then 'html' when lang = 'fr' then 'pages' end route,
  case when lang not in ('en', 'fr') then 'Unsupported source type: ' || lang end as "error" from documents""")
def document_routes(spark, d):
    kind = F.when(F.col("lang") == "en", "html").when(F.col("lang") == "fr", "pdf").otherwise(F.col("lang"))
    rows = table(spark, d, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("document_id"), kind.alias("source_type"))
    return normalise.route(rows).select("document_id", "route", "error")
