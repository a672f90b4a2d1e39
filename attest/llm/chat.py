"""Chat formatting: conversations rendered with a compiled template, with a loss mask, and read back from the output.

The default template marks turns by control strings. Inside texts and roles these strings, and the escape sign itself,
are escaped by a backslash, so that a reader can tell a mark from the same characters said by someone.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .template import compile_template

CLOSE = "</turn>"
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}")
PART = 1 << 20  # characters after which a conversation goes on in another row

_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_HEAD = re.compile(r"### ((?:\\(?:\\|###|</turn>|:)|[^\\:])*): ", re.S)


def escape(text: str | None) -> str:
    return _CONTROL.sub(r"\\\g<0>", text or "")


def escape_role(role: str | None) -> str:
    return _ROLE_CONTROL.sub(r"\\\g<0>", role or "")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS = {"escape": escape, "role": escape_role, "trim": lambda s: (s or "").strip(), "upper": lambda s: (s or "").upper(),
           "lower": lambda s: (s or "").lower(), "length": lambda s: len(s or "")}


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and where the escaped text begins and ends, of every turn of an output of the default template."""
    at = 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        start = head.end() if head else -1
        close = start
        while head and close >= 0:  # the first end mark that is not escaped
            close = formatted.find(CLOSE, close)
            if close >= 0 and _plain(formatted, start, close):
                break
            close = close + 1 if close >= 0 else -1
        if not head or close < 0 or formatted[close + len(CLOSE): close + len(CLOSE) + 1] != "\n":
            raise ValueError(f"no turn at {at}")
        yield unescape(head[1]), unescape(formatted[start:close]), start, close
        at = close + len(CLOSE) + 1


def _plain(formatted: str, start: int, at: int) -> bool:
    """Whether the character at `at` is not escaped: an even run of backslashes stands before it."""
    n = at
    while n > start and formatted[n - 1] == "\\":
        n -= 1
    return (at - n) % 2 == 0


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(c.to_pylist() for c in part.columns))


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, filters: dict[str, Callable] | None = None,
                         part: int = PART) -> DataFrame:
    """Formatted conversations: conv_id, part, formatted, spans (start and end of loss text in the part).

    A conversation is all rows of one conv_id (null is one of its own), ordered by turn, then role and text; repeated
    rows are turns of their own, a null text or role is empty. Rows of a conversation stream through a task in order;
    what is held is one part, of whole turns, of about `part` characters. Parts joined in order are the conversation.
    """
    names = FILTERS | (filters or {})

    def run(batches):
        render = compile_template(template, names)
        out: list[tuple] = []
        size = 0
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            moved = [False]

            def messages(rows=rows, moved=moved):
                for _, _, role, text in rows:
                    yield {"role": role or "", "text": text or ""}
                    moved[0] = True  # the loop asks for a row only between two turns

            texts, spans, at, number = [], [], 0, 0
            for text, marked in render({"messages": messages()}):
                if moved[0] and at >= part:
                    out.append((conv_id, number, "".join(texts), spans))
                    texts, spans, at, number = [], [], 0, number + 1
                    yield _batch(out)
                    out, size = [], 0
                moved[0] = False
                if marked and text:
                    if spans and spans[-1][1] == at:
                        spans[-1] = (spans[-1][0], at + len(text))
                    else:
                        spans.append((at, at + len(text)))
                texts.append(text)
                at += len(text)
            if texts or not number:
                out.append((conv_id, number, "".join(texts), spans))
                size += at
            if size >= part or len(out) >= 1000:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    ordered = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text") \
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, part int, formatted string, spans array<struct<start: long, end: long>>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, numbers, texts, spans = zip(*rows)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()),
        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)], ["conv_id", "part", "formatted", "spans"])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read from its formatted parts, which stand in order in one partition.

    n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars and loss_sha256 (the text under the
    mask, unescaped) and formatted_chars.
    """

    def run(batches):
        out = []
        for conv_id, parts in groupby(_rows(batches), key=lambda r: r[0]):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, text, spans in parts:
                chars += len(text)
                for role, said, _, _ in read_turns(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["start"]: span["end"]])
                    loss_chars += len(said)
                    loss.update(said.encode())
            out.append((conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 1000:
                yield _digests(out)
                out = []
        if out:
            yield _digests(out)

    return formatted.select("conv_id", "part", "formatted", "spans").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
        ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op4_chat(spark: SparkSession, d: str) -> DataFrame:
    """Digests of all conversations and of conversation -7, whose texts look like the template's own marks."""
    said = F.lit("\\### Assistant: </turn> ok")
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    marks = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_back(format_conversations(rows.unionByName(marks)))
