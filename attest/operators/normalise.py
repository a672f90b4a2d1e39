"""Pages and raw elements to evidence blocks (N-01 .. N-24)."""
from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C
from ..functions import text as X
from ..schemas import CITATION
from .ordered import SEGMENT, dedup_adjacent, heading_stack, scan, segment_of

PAGES_PER_SEGMENT = 128
ROWS_PER_SEGMENT = 8192

Rules = Mapping[str, C.PageRules]


def _per_source(rules: Rules, build, otherwise: Column) -> Column:
    """One CASE over the configured sources; ``build`` makes the branch of a rule set."""
    out = None
    for source, rule in rules.items():
        branch = build(rule)
        if branch is None:
            continue
        hit = F.col("source_id") == source
        out = F.when(hit, branch) if out is None else out.when(hit, branch)
    return otherwise if out is None else out.otherwise(otherwise)


def at_start(pattern: str) -> str:
    """A user's heading pattern holds from the start of the line on."""
    return rf"(?iu)\A(?:{pattern})"


def titled(c: Column) -> Column:
    """Every letter behind a character that is no letter as a capital, the others small."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def any_match(c: Column, patterns: tuple[str, ...]) -> Column:
    return c.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


# --- line level -------------------------------------------------------------------------------


def _heading(level: Column, heading: Column, hid: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), heading.alias("heading"), hid.cast("string").alias("id"))


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


def numbered_heading(line: Column, rule: C.PageRules) -> Column:
    """N-10: part, then section, then clause, then any numbered section."""
    cases: list[tuple[Column, Column]] = []
    capitals = (F.upper(line) == line) & (F.lower(line) != line)
    for p in rule.part_patterns:
        pattern = at_start(p)
        part = _group(line, pattern) if re.compile(p).groups else line
        title = F.when(capitals, titled(line)).otherwise(line)
        cases.append((line.rlike(pattern), _heading(F.lit(1), title, F.concat(F.lit("part_"), part))))
    for p in rule.section_patterns:
        pattern = at_start(p)
        hid = _group(line, pattern) if re.compile(p).groups else F.lit(None)
        cases.append((line.rlike(pattern), _heading(F.lit(2), line, hid)))
    for p in [*map(at_start, rule.clause_patterns), C.NUMBERED_SECTION]:
        hid = _group(line, p)
        dots = F.length(hid) - F.length(F.replace(hid, F.lit("."), F.lit("")))
        cases.append((line.rlike(p), _heading(dots + 3, line, hid)))
    return _first_case(cases)


def lettered_heading(line: Column) -> Column:
    """N-11, N-12: appendix, letter, number, small letter, title-like roman numeral."""
    appendix, letter = r"(?i)^APPENDIX\s+([A-Z])$", r"^([A-P])\.\s+(.+)$"
    number, small, roman = r"^(\d+)\.\s+(.+)$", r"^([a-z]{1,2})\.\s+(.+)$", r"(?i)^([ivxlcdm]+)\)\s+(.+)$"
    which = F.upper(_group(line, appendix))
    label = F.trim(_group(line, roman, 2))
    first = F.substring(label, 1, 1)
    title_like = (
        line.rlike(roman)
        & (F.length(label) <= 80)
        & (F.upper(first) == first) & (F.lower(first) != first)
        & ~label.rlike(r"[.;:]$")
    )
    cases = [
        (line.isin(*C.NEVER_HEADINGS), F.lit(None).cast("struct<level:int,heading:string,id:string>")),
        (line.rlike(appendix), _heading(F.lit(1), F.concat(F.lit("APPENDIX "), which), F.concat(F.lit("appendix_"), which))),
        (line.rlike(letter), _heading(F.lit(1), line, _group(line, letter))),
        (line.rlike(number), _heading(F.lit(2), line, _group(line, number))),
        (line.rlike(small), _heading(F.lit(3), line, _group(line, small))),
        (title_like, _heading(F.lit(4), line, F.lower(_group(line, roman)))),
    ]
    return _first_case(cases)


def _first_case(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for when, then in cases[1:]:
        out = out.when(when, then)
    return out


def is_administrative(line: Column) -> Column:
    """N-19."""
    hit = F.lit(False)
    for p in C.ADMIN_PATTERNS:
        hit = hit | line.rlike(p)
    for start in C.ADMIN_STARTS:
        hit = hit | line.startswith(start)
    return hit


def sheet_metadata(page_text: Column) -> Column:
    """N-18: first sheet numbers, date and letter found on the page."""
    flat = X.collapse(page_text)
    return F.struct(*[
        F.nullif(F.regexp_extract(flat, p, 1), F.lit("")).alias(name) for name, p in C.SHEET_PATTERNS.items()
    ])


def page_lines(pages: DataFrame, rules: Rules, default: C.PageRules = C.PageRules(),
               pages_per_segment: int = PAGES_PER_SEGMENT, label_lines: int | None = None) -> DataFrame:
    """N-06 .. N-12, N-18 .. N-20: one classified line per row.

    ``pages``: document_id, source_id, source_hash, page_number, text. The line
    kind is one of blank, boilerplate, label, heading, text. Everything here is
    a narrow transformation of the page row. A printed label is looked for in all lines of the
    page, or in the first ``label_lines``.
    """
    skipped = _per_source(
        rules, lambda r: F.col("page_number").isin(*r.skip_pages) if r.skip_pages else F.lit(False),
        F.col("page_number").isin(*default.skip_pages) if default.skip_pages else F.lit(False))
    kept = pages.where(~skipped & ~is_contents_page(rules, default))
    lettered = _per_source(rules, lambda r: F.lit(r.lettered), F.lit(default.lettered))
    # Page-level values are computed in a step of their own, before the explode, so
    # that they are evaluated once per page rather than once per line.
    label = F.filter(F.transform(F.slice("lines", 1, label_lines) if label_lines else F.col("lines"), X.collapse), lambda s: s.rlike(C.PRINTED_PAGE))
    kept = kept.select(
        "document_id", "source_id", "source_hash", "page_number",
        segment_of(F.col("page_number"), pages_per_segment).alias(SEGMENT),
        F.when(lettered, sheet_metadata(F.col("text"))).alias("sheet"),
        lettered.alias("lettered"),
        X.lines(F.col("text")).alias("lines"),
    ).withColumn("printed_page", F.when(~F.col("lettered"), F.get(label, F.lit(0))))
    # The outer form keeps Spark from repeating the split in a filter on its size.
    kept = kept.select("*", F.posexplode_outer("lines").alias("line_no", "line")).drop("lines").where("line_no is not null")
    kept = kept.withColumn("line", X.collapse(F.col("line")))

    def repeated(rule: C.PageRules) -> Column:
        if rule.lettered:
            return is_administrative(F.col("line"))
        return any_match(F.col("line"), rule.repeated_lines) if rule.repeated_lines else F.lit(False)

    def heading(rule: C.PageRules) -> Column:
        return lettered_heading(F.col("line")) if rule.lettered else numbered_heading(F.col("line"), rule)

    kind = (
        F.when(F.col("line") == "", "blank")
        .when(_per_source(rules, repeated, repeated(default)), "boilerplate")
        .when(F.col("line").eqNullSafe(F.col("printed_page")), "label")
    )
    found = kept.withColumn("kind", kind).withColumn(
        "found", F.when(F.col("kind").isNull(), _per_source(rules, heading, heading(default)))
    )
    return found.withColumn(
        "kind", F.coalesce("kind", F.when(F.col("found").isNotNull(), F.lit("heading")).otherwise("text"))
    )


def is_contents_page(rules: Rules, default: C.PageRules = C.PageRules()) -> Column:
    """N-20: contents pages of lettered sources."""
    lettered = _per_source(rules, lambda r: F.lit(r.lettered), F.lit(default.lettered))
    return lettered & F.coalesce(X.collapse(F.col("text")).contains(C.CONTENTS_MARK), F.lit(False))


def block_type(joined: Column) -> Column:
    """N-15."""
    bullet = F.lit(False)
    for b in C.BULLETS:
        bullet = bullet | joined.startswith(b)
    return (
        F.when(bullet | joined.rlike(C.LIST_START), "list_item")
        .when(F.lower(joined).startswith("table "), "table")
        .otherwise("paragraph")
    )


# --- blocks -----------------------------------------------------------------------------------


def assemble(lines: DataFrame, keep: tuple[str, ...] = ("source_id", "source_hash", "printed_page", "sheet", "lettered")) -> DataFrame:
    """N-14: consecutive text lines of a page become one block; blank lines, headings and page ends close it.

    Lines and blocks share one exchange on (document, segment).
    """
    # Lines are told apart by conditions inside the windows and filtered after
    # them: a filter on the line kind in front would be pushed to the scan and
    # evaluate every pattern twice.
    used = F.col("kind").isin("blank", "heading", "text")
    inside = Window.partitionBy("document_id", SEGMENT).orderBy("page_number", "line_no")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.last(F.when(used, F.struct("page_number", "kind")), ignorenulls=True).over(earlier)
    after_text = before.eqNullSafe(F.struct("page_number", F.lit("text").alias("kind")))
    starts = (F.col("kind") == "heading") | ((F.col("kind") == "text") & ~after_text)
    numbered = lines.withColumn("__starts", starts.cast("int"))
    numbered = numbered.withColumn("__island", F.sum("__starts").over(upto)).where(F.col("kind").isin("heading", "text"))
    return numbered.groupBy("document_id", SEGMENT, "__island").agg(
        *[F.first(c).alias(c) for c in keep],
        F.first("page_number").alias("page_number"),
        F.min("line_no").alias("line_no"),
        F.first("found").alias("found"),
        X.ordered_text(F.col("line"), F.col("line_no"), " ").alias("text"),
        F.count("*").alias("n_lines"),
    ).drop("__island")


def page_blocks(lines: DataFrame, max_level: int = C.DEEPEST_HEADING) -> DataFrame:
    """N-05, N-13 .. N-17, N-21, N-22: classified lines to finished blocks. Deeper headings than declared are an error."""
    raw = assemble(lines).withColumn("level", F.col("found.level"))
    is_heading = F.col("found").isNotNull()
    with_path = heading_stack(
        raw, ["document_id"], SEGMENT, ["page_number", "line_no"], "level", F.col("found.heading"), F.col("found.id"),
        sums={"ordinal": F.lit(1)}, max_level=max_level,
    )
    numeric = F.transform(
        F.filter(F.col("heading_path"), lambda h: h.rlike(r"^\d+(?:\.\d+)+")), lambda h: F.split(h, " ")[0])
    own = F.filter(F.array(F.col("found.id")), lambda i: i.isNotNull() & (i != ""))
    sections = F.when(F.col("lettered"), F.col("heading_ids")).when(is_heading, own).otherwise(numeric)
    page = F.col("page_number").cast("int")
    printed = F.when(F.col("lettered"), F.col("sheet.tariff_rule_sheet")).otherwise(F.col("printed_page"))
    citation = citation_of(
        pdf_page_start=page, pdf_page_end=page, printed_page_start=printed, printed_page_end=printed,
        section_ids=sections, **{n: F.col(f"sheet.{n}") for n in C.SHEET_PATTERNS})
    text = F.when(is_heading, F.col("found.heading")).otherwise(F.col("text"))
    kind = F.when(is_heading, "heading").otherwise(block_type(F.col("text")))
    no_path = ~is_heading & (F.size("heading_path") == 0)
    return with_path.select(
        F.format_string("%s:p%03d:b%04d", F.col("document_id"), page, F.col("ordinal")).alias("block_id"),
        "document_id", "source_id", "source_hash", F.col("ordinal").cast("long").alias("ordinal"),
        kind.alias("block_type"), text.alias("text"), "heading_path", citation.alias("citation"),
        (kind != "boilerplate").alias("is_substantive"),
        F.when(no_path, F.array(F.lit("no_detected_heading_path"))).otherwise(F.array().cast("array<string>"))
        .alias("normalisation_flags"),
        F.col("found.level").alias("heading_level"), F.col("found.heading").alias("heading"),
    )


def citation_of(**parts: Column) -> Column:
    """N-21: the full citation struct; parts not given are null."""
    return F.struct(*[
        parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CITATION.fields
    ])


def normalise_pages(pages: DataFrame, rules: Rules, default: C.PageRules = C.PageRules(),
                    pages_per_segment: int = PAGES_PER_SEGMENT) -> DataFrame:
    return page_blocks(page_lines(pages, rules, default, pages_per_segment))


def page_summary(pages: DataFrame, rules: Rules, default: C.PageRules = C.PageRules()) -> DataFrame:
    """N-24 for page sources."""
    lines = page_lines(pages, rules, default)
    blocks = page_blocks(lines).groupBy("document_id").agg(
        F.count("*").alias("output_blocks"),
        F.count_if(F.array_contains("normalisation_flags", "no_detected_heading_path")).alias("blocks_flagged_for_review"))
    removed = lines.groupBy("document_id").agg(F.count_if(F.col("kind") == "boilerplate").alias("boilerplate_lines_removed"))
    base = pages.groupBy("document_id").agg(
        F.count("*").alias("input_pages"),
        F.count_if(is_contents_page(rules, default)).alias("contents_pages_skipped"))
    out = base.join(blocks, "document_id", "left").join(removed, "document_id", "left")
    return out.na.fill(0)


def html_keys(raw: DataFrame, rules: Mapping[str, C.HtmlRules]) -> DataFrame:
    """N-01, N-02, N-03: clean element text and path, drop configured paths and texts."""
    is_table = F.col("block_type") == "table"
    rows = raw.withColumn("block_type", F.coalesce("block_type", F.lit("unknown"))).withColumn(
        "text", F.coalesce(F.when(is_table, F.col("text")).otherwise(X.collapse(F.col("text"))), F.lit(""))
    ).withColumn("heading_path", X.heading_path(F.col("heading_path")))
    rows = rows.where(F.col("text") != "")
    for source, rule in rules.items():
        path_hit = X.join_path(F.col("heading_path")).isin(*rule.drop_paths) if rule.drop_paths else F.lit(False)
        text_hit = F.col("text").isin(*rule.drop_texts) if rule.drop_texts else F.lit(False)
        rows = rows.where(~((F.col("source_id") == source) & (path_hit | text_hit)))
    return rows


def normalise_html(raw: DataFrame, rules: Mapping[str, C.HtmlRules] = {}, rows_per_segment: int = ROWS_PER_SEGMENT, one_segment: bool = False) -> DataFrame:
    """N-03 .. N-05, N-22 for raw elements.

    ``raw``: document_id, source_id, source_hash, seq, block_type, heading_level, heading, heading_path, text.
    ``one_segment`` says that a document is one page, so one input row; ``raw`` is then read once, not once for each pass.
    """
    rows = html_keys(raw, rules).withColumn(SEGMENT, F.lit(0).cast("long") if one_segment else segment_of(F.col("seq"), rows_per_segment))
    marked = dedup_adjacent(rows, ["document_id"], SEGMENT, ["seq"], ["block_type", "text", "heading_path"], one_segment=one_segment)
    kept = marked.where(~F.col("is_repeat"))
    numbered = scan(kept, ["document_id"], SEGMENT, ["seq"], sums={"ordinal": F.lit(1)}, one_segment=one_segment)
    return numbered.select(
        F.format_string("%s:b%04d", F.col("document_id"), F.col("ordinal")).alias("block_id"),
        "document_id", "source_id", "source_hash", F.col("ordinal").cast("long").alias("ordinal"), "block_type", "text",
        "heading_path", citation_of(heading_path=F.col("heading_path")).alias("citation"),
        (F.col("block_type") != "boilerplate").alias("is_substantive"),
        F.array().cast("array<string>").alias("normalisation_flags"),
        F.col("heading_level").cast("int").alias("heading_level"), F.col("heading").alias("heading"),
    )


def html_summary(raw: DataFrame, rules: Mapping[str, C.HtmlRules] = {}, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """N-24 for element sources."""
    rows = html_keys(raw, rules).withColumn(SEGMENT, segment_of(F.col("seq"), rows_per_segment))
    marked = dedup_adjacent(rows, ["document_id"], SEGMENT, ["seq"], ["block_type", "text", "heading_path"])
    out = marked.groupBy("document_id").agg(
        F.count_if(~F.col("is_repeat")).alias("output_blocks"),
        F.count_if(F.col("is_repeat")).alias("adjacent_duplicates_suppressed"))
    base = raw.groupBy("document_id").agg(F.count("*").alias("input_blocks"))
    return base.join(out, "document_id", "left").na.fill(0).withColumn("blocks_flagged_for_review", F.lit(0))


def route(documents: DataFrame, lettered: tuple[str, ...] = ()) -> DataFrame:
    """N-23: which rules a document takes; an unknown type gets an error instead."""
    kind = (
        F.when(F.col("source_type") == "html", "html")
        .when(F.col("document_id").isin(*lettered) if lettered else F.lit(False), "lettered")
        .when(F.col("source_type") == "pdf", "pages")
    )
    error = F.concat(F.lit("Unsupported source type: "), F.coalesce("source_type", F.lit("None")))
    return documents.withColumn("route", kind).withColumn("error", F.when(kind.isNull(), error))
