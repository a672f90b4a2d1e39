"""Text expressions. All are plain Column expressions and stay inside the JVM."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters, numbers and underscore: the word class used for every token rule.
WORD = r"[\p{L}\p{N}_]"
# Unicode white space plus the four ASCII separators that Java leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]"
# Characters that end a line, besides "\n" and "\r\n".
OTHER_BREAKS = "\u000b\u000c\r\u001c\u001d\u001e\u0085\u2028\u2029"
TOKEN = rf"(?U){WORD}+(?:['’-]{WORD}+)?|[^\p{{L}}\p{{N}}_\s\x1c-\x1f]"


def collapse(c: Column) -> Column:
    """N-01: every run of white space becomes one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip(c: Column) -> Column:
    """Trim any white space at both ends, keeping the inside as it is."""
    return F.regexp_replace(c, rf"{SPACE}+\z|\A{SPACE}+", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def heading_path(c: Column) -> Column:
    """N-02: split a ' > ' path into its non-empty, collapsed parts."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), " > "), collapse)
    return F.filter(parts, lambda x: x != "")


def clean_path(c: Column) -> Column:
    """N-02 for a path that is already an array."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), collapse), lambda x: x != "")


def join_path(c: Column) -> Column:
    return F.array_join(c, " > ")


def token_count(c: Column) -> Column:
    """C-01: words with one inner joint, or single punctuation marks."""
    return F.regexp_count(c, F.lit(TOKEN)).cast("int")


def word_count(c: Column) -> Column:
    flat = collapse(c)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def words(c: Column) -> Column:
    """Lower-cased word list in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"({WORD}+)"), F.lit(1))


def lines(c: Column) -> Column:
    """N-07: text to lines; a final line break does not open another line.

    Texts that hold other breaks have them mapped first, so that the split is a
    plain character split; telling those texts apart is a byte search.
    """
    raw = F.coalesce(c, F.lit(""))
    other = F.lit(False)
    for b in OTHER_BREAKS:
        other = other | F.contains(raw, F.lit(b))
    mapped = F.translate(F.replace(raw, F.lit("\r\n"), F.lit("\n")), OTHER_BREAKS, "\n" * len(OTHER_BREAKS))
    text = F.when(other, mapped).when(raw != "", raw)
    return F.split(F.regexp_replace(text, "\n\\z", ""), "\n")


def title_words(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def sha256_tag(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def ordered_text(value: Column, order: Column, separator: str) -> Column:
    """Aggregate: join values in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


def ordered_list(value: Column, order: Column) -> Column:
    """Aggregate: values in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(rows, lambda r: r["v"])
