"""Pages with the structures that the given tables lack: links, lists, tables, labels, sheets and lettered headings.

Each page is built around the whole text of a document, so that its work grows with the documents.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X
from ..operators import html, normalise
from . import query
from .common import sql_collapse, table

BODY_SQL = sql_collapse("'Body: ' || text")


def _body():
    return X.collapse(F.concat(F.lit("Body: "), "text"))


def _page(parts):
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def rich_pages(spark, d):
    """Menu and footer, a main part by role, headings, a link, nested lists, an accordion, tables, and the text of the document."""
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    n, lang = F.col("doc_id").cast("string"), F.col("lang")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit("http://docs.example/a/").alias("url"),
        F.concat(
            F.lit("<html><body><nav><p>menu</p></nav><div role='main'><h2>Page <b>"), n, F.lit("</b><!-- no --></h2><p>See <a href='../b/"), n,
            F.lit("'>the <i>"), lang, F.lit("</i> list</a> now<!-- said --></p><p>"), escaped, F.lit("</p><ul><li>one<ul><li>in "), n,
            F.lit("</li></ul></li></ul><button class='x-Accordion'>More</button><button>none</button><h3> </h3><table><tr><th>id</th><th>lang</th></tr><tr><td>"), n,
            F.lit("</td></tr></table><table>plain <a href='x'>cell</a></table><form><p>no</p></form></div><footer><p>end</p></footer></body></html>")).alias("html"))


@query("html_rich_blocks", f"""
with b as (select doc_id, lang, {sql_collapse('text')} body from documents),
rows_ as (
  select doc_id, 1 n, 'heading' block_type, 2 heading_level, 'Page ' || doc_id as "text", 'Page ' || doc_id heading_path from b
  union all select doc_id, 2, 'paragraph', null, 'See [the ' || lang || ' list](http://docs.example/b/' || doc_id || ') the ' || lang || ' list now said', 'Page ' || doc_id from b
  union all select doc_id, 3, 'paragraph', null, body, 'Page ' || doc_id from b where body <> ''
  union all select doc_id, 4, 'list_item', null, '- one in ' || doc_id, 'Page ' || doc_id from b
  union all select doc_id, 5, 'list_item', null, '- in ' || doc_id, 'Page ' || doc_id from b
  union all select doc_id, 6, 'heading', 3, 'More', 'Page ' || doc_id || ' > More' from b
  union all select doc_id, 7, 'table', null, '| id | lang |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' |  |', 'Page ' || doc_id || ' > More' from b
  union all select doc_id, 8, 'table', null, 'plain cell', 'Page ' || doc_id || ' > More' from b)
select doc_id page_id, row_number() over (partition by doc_id order by n)::int seq, block_type, heading_level, "text", heading_path from rows_""")
def html_rich_blocks(spark, d):
    return html.html_blocks(rich_pages(spark, d)).select("page_id", "seq", "block_type", "heading_level", "text", "heading_path")


@query("html_dropped_parts", f"""
with b as (select doc_id, {sql_collapse('text')} body from documents)
select 'w' || doc_id document_id, (6 + case when body not in ('', 'plain cell') then 1 else 0 end)::bigint n from b""")
def html_dropped_parts(spark, d):
    """Blocks of each page when the source drops one of its texts."""
    rows = html.html_blocks(rich_pages(spark, d)).select(
        F.concat(F.lit("w"), "page_id").alias("document_id"), F.lit("web").alias("source_id"), F.lit(None).cast("string").alias("source_hash"),
        "seq", "block_type", "heading_level", "heading", "heading_path", "text")
    rules = {"web": C.HtmlRules(drop_texts=("plain cell",))}
    return normalise.normalise_html(rows, rules, one_segment=True).groupBy("document_id").agg(F.count("*").alias("n"))  # a document is one page


def lettered_pages(spark, d):
    """Two pages of a lettered source: a contents page, and one with sheet data and four levels of headings."""
    n = F.col("doc_id").cast("string")
    page = _page([F.concat(F.lit("Rule 21 Sheet "), n), F.concat(F.lit("Revised Cal. PUC Sheet No. "), n, F.lit("-E")), "Effective March 5, 2024", "Advice 12-E",
                  "APPENDIX b", F.concat(F.lit("A. "), F.col("lang")), "1. First", "a. small", "iv) Title like", _body()])
    return table(spark, d, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("document_id"), F.col("source").alias("source_id"), F.lit(None).cast("string").alias("source_hash"),
        F.explode(F.array(F.struct(F.lit(1).alias("page_number"), F.concat(F.lit("A. TABLE OF CONTENTS\n"), "text").alias("text")),
                          F.struct(F.lit(2).alias("page_number"), page.alias("text")))).alias("p")).select("document_id", "source_id", "source_hash", "p.*")


def _cited(blocks):
    c = F.col("citation")
    return blocks.select(
        "document_id", "ordinal", "text", X.join_path(F.col("heading_path")).alias("heading_path"), F.array_join(c["section_ids"], ",").alias("section_ids"),
        c["printed_page_start"].alias("printed"), c["pdf_page_start"].alias("page"), c["tariff_cpuc_sheet"].alias("cpuc_sheet"),
        c["tariff_effective_date"].alias("effective"), c["tariff_advice_letter"].alias("advice"))


@query("lettered_blocks", f"""
with b as (select doc_id, lang, 'A. ' || lang a, {BODY_SQL} body from documents),
rows_ as (
  select doc_id, 1 n, 'Revised Cal. PUC Sheet No. ' || doc_id || '-E Effective March 5, 2024' t, '' p, '' s from b
  union all select doc_id, 2, 'APPENDIX B', 'APPENDIX B', 'appendix_B' from b
  union all select doc_id, 3, a, a, 'A' from b
  union all select doc_id, 4, '1. First', a || ' > 1. First', 'A,1' from b
  union all select doc_id, 5, 'a. small', a || ' > 1. First > a. small', 'A,1,a' from b
  union all select doc_id, 6, 'iv) Title like', a || ' > 1. First > a. small > iv) Title like', 'A,1,a,iv' from b
  union all select doc_id, 7, body, a || ' > 1. First > a. small > iv) Title like', 'A,1,a,iv' from b)
select 'd' || doc_id document_id, n::bigint ordinal, t as "text", p heading_path, s section_ids, doc_id::varchar printed, 2 page, doc_id || '-E' cpuc_sheet,
  'March 5, 2024' effective, '12-E' advice from rows_""")
def lettered_blocks(spark, d):
    return _cited(normalise.normalise_pages(lettered_pages(spark, d), {}, C.PageRules(lettered=True)))


def numbered_pages(spark, d):
    """Two pages of a numbered source, of which one is skipped, with a printed label in the last line."""
    page = _page(["PART 1: GENERAL-PURPOSE RULES", F.concat(F.lit("1.2 Scope "), F.col("lang")), _body(), "a PART 2: no heading", "running line", "Page 7"])
    return table(spark, d, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("document_id"), F.col("source").alias("source_id"), F.lit(None).cast("string").alias("source_hash"),
        F.explode(F.array(F.struct(F.lit(1).alias("page_number"), page.alias("text")), F.struct(F.lit(2).alias("page_number"), F.col("text").alias("text")))).alias("p")) \
        .select("document_id", "source_id", "source_hash", "p.*")


@query("numbered_blocks", f"""
with b as (select doc_id, '1.2 Scope ' || lang s, {BODY_SQL} body, 'Part 1: General-Purpose Rules' part from documents),
rows_ as (
  select doc_id, 1 n, part t, part p, 'part_1' i from b
  union all select doc_id, 2, s, part || ' > ' || s, '1.2' from b
  union all select doc_id, 3, body || ' a PART 2: no heading', part || ' > ' || s, '1.2' from b)
select 'd' || doc_id document_id, n::bigint ordinal, t as "text", p heading_path, i section_ids, 'Page 7' printed, 1 page, null::varchar cpuc_sheet,
  null::varchar effective, null::varchar advice from rows_""")
def numbered_blocks(spark, d):
    rules = C.PageRules(skip_pages=(2,), repeated_lines=(r"^running line$",), part_patterns=(r"PART (\d+):.*",))
    return _cited(normalise.normalise_pages(numbered_pages(spark, d), {}, rules))
