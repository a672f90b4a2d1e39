"""Structural chunking (C-02 .. C-13).

Where a chunk ends depends only on where it starts: its first path, its running
token sum and whether it holds headings only are all fixed by its first block.
So "the next chunk starts at" is a function of a block position, and it looks
ahead by a bounded number of blocks, because every block has a token and a chunk
closes soon after the soft limit. That allows a long document to be cut into
segments which are solved apart:

1. each segment gets the first blocks of the next one as look-ahead and reports,
   for every position at which it may be entered, where it would be left;
2. the short list of those intervals gives every segment its true entry;
3. each segment then lists its chunks.

Documents that fit one segment, nearly all, skip the first two steps.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import text as X
from ..schemas import CITATION
from ..session import materialise
from .normalise import citation_of
from .ordered import SEGMENT, scan, segment_of

BLOCKS_PER_SEGMENT = 8192
MEMBERS = "document_id string, __segment long, start long, part int, pos long"
EXITS = "document_id string, __segment long, low long, high long, exit long"


def substantive(blocks: DataFrame) -> DataFrame:
    """C-02."""
    return blocks.where(F.coalesce("is_substantive", F.lit(True)) & ~X.is_blank(F.col("text")))


def next_start(i: int, heading, table, path, tokens, soft: int, hard: int, end: int) -> int:
    """Position after the chunk that starts at ``i``; ``end`` when the rows run out first."""
    if table[i]:
        return i + 1
    total, first, headings_only = tokens[i], path[i], bool(heading[i])
    j = i + 1
    while j < end:
        size = tokens[j]
        new_section = heading[j] and path[j] != first and not headings_only
        if new_section or total + size > soft:
            return j
        if table[j]:
            return j + 1 if total + size <= hard else j
        total += size
        headings_only = headings_only and bool(heading[j])
        j += 1
    return end


def split_parts(start: int, stop: int, tokens, limits: C.ChunkLimits) -> list[list[int]]:
    """C-05: parts of one chunk above the hard limit.

    With running token sums both bounds of a part are positions found by bisection: it ends where the sum since its
    first block passes the hard limit, but after one new block at least, and the next one begins as far back as the
    overlap reaches, but with one old block at least.
    """
    sums = list(accumulate(tokens[start:stop], initial=0))
    n, first, end, parts = stop - start, 0, 0, []
    while end < n:
        fits = bisect_right(sums, sums[first] + limits.hard) - 1
        end = min(n, max(end + 1, fits))
        parts.append(list(range(start + first, start + end)))
        first = max(first, min(end - 1, bisect_left(sums, sums[end] - limits.overlap)))
    return parts


FLUSH_ROWS = 50_000


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[dict[str, list], int, int]]:
    """Runs of equal (document, segment) in sorted batches, as column lists and bounds.

    A run may span batches; it is bounded by the segment size.
    """
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if rows.empty:
            continue
        doc, seg = rows["document_id"].to_numpy(), rows[SEGMENT].to_numpy()
        cuts = (np.flatnonzero((doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1])) + 1).tolist()
        if cuts:
            cols = {c: rows[c].iloc[:cuts[-1]].tolist() for c in rows.columns}
            for a, b in zip([0, *cuts], cuts):
                yield cols, a, b
            rows = rows.iloc[cuts[-1]:]
        rest = rows
    if rest is not None and len(rest):
        yield {c: rest[c].tolist() for c in rest.columns}, 0, len(rest)


def _state(cols: dict[str, list], a: int, b: int) -> tuple[list, list, list, list, list]:
    return tuple(cols[c][a:b] for c in ("pos", "is_heading", "is_table", "path_key", "tokens"))


def segment_exits(limits: C.ChunkLimits):
    """Step 1: (entry interval -> exit) of a segment, for every entry a predecessor may choose."""

    def run(batches):
        out = []
        for cols, a, b in _runs(batches):
            pos, *state = _state(cols, a, b)
            doc, seg, n = cols["document_id"][a], cols[SEGMENT][a], b - a
            inside = bisect_left(pos, cols["segment_end"][a])
            first = cols["is_first"][a]
            entries = 1 if first else min(inside, max(limits.soft, limits.hard) + 2)
            exits, memo = [], {}
            for e in range(entries):
                i, seen = e, []
                while i < inside and i not in memo:
                    seen.append(i)
                    i = next_start(i, *state, limits.soft, limits.hard, n)
                leave = memo.get(i, i)
                memo.update((s, leave) for s in seen)
                exits.append(leave)
            low = 0
            for e in range(1, entries + 1):
                if e == entries or exits[e] != exits[low]:
                    x = exits[low]
                    out.append((doc, seg, pos[low], pos[e - 1], pos[x] if x < n else pos[-1] + 1))
                    low = e
            if len(out) >= FLUSH_ROWS:
                yield pd.DataFrame(out, columns=["document_id", SEGMENT, "low", "high", "exit"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["document_id", SEGMENT, "low", "high", "exit"])

    return run


def segment_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 2 over the exit intervals of a document, in segment order: follow the true entries."""
    current, entry, segment = None, 0, None
    for batch in batches:
        out = []
        for doc, seg, low, high, leave in zip(*(batch[c].tolist() for c in ("document_id", SEGMENT, "low", "high", "exit"))):
            if doc != current:
                current, entry, segment = doc, low, None
            if seg != segment and low <= entry <= high:
                out.append((doc, seg, entry))
                entry, segment = leave, seg
        if out:
            yield pd.DataFrame(out, columns=["document_id", SEGMENT, "entry"])


def segment_members(limits: C.ChunkLimits):
    """Step 3: chunk members (start, part, pos) of a segment, from its true entry."""
    names = ["document_id", SEGMENT, "start", "part", "pos"]

    def run(batches):
        out = []
        for cols, a, b in _runs(batches):
            pos, *state = _state(cols, a, b)
            doc, seg, n, inside = cols["document_id"][a], cols[SEGMENT][a], b - a, bisect_left(pos, cols["segment_end"][a])
            i = bisect_left(pos, cols["entry"][a])
            while i < inside:
                j = next_start(i, *state, limits.soft, limits.hard, n)
                for k, members in enumerate(split_parts(i, j, state[3], limits)):
                    out += [(doc, seg, pos[i], k, pos[m]) for m in members]
                i = j
            if len(out) >= FLUSH_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


def chunk_members(blocks: DataFrame, limits: C.ChunkLimits = C.ChunkLimits(),
                  blocks_per_segment: int = BLOCKS_PER_SEGMENT) -> DataFrame:
    """C-04, C-05: document_id, chunk_ordinal, has_next, pos, ordinal: which blocks form which chunk.

    ``blocks``: substantive blocks. Only narrow columns are shuffled and travel
    to Python, never text; the two narrow results are written out once.
    """
    ahead = max(limits.soft, limits.hard) + 2
    size = max(blocks_per_segment, ahead)
    rows = blocks.select(
        "document_id", "ordinal", (F.col("block_type") == "heading").alias("is_heading"),
        (F.col("block_type") == "table").alias("is_table"),
        F.xxhash64(X.join_path(F.coalesce("heading_path", F.array().cast("array<string>")))).alias("path_key"),
        X.token_count(F.col("text")).alias("tokens"), segment_of(F.col("ordinal"), size).alias(SEGMENT))
    # Dense positions from 1, so that look-ahead can be taken by position.
    dense = scan(rows, ["document_id"], SEGMENT, ["ordinal"], sums={"pos": F.lit(1)}).withColumn(
        SEGMENT, segment_of(F.col("pos"), size))
    rows = materialise(dense, "chunk-rows")

    # The first rows of a segment go to the segment before as well, as look-ahead.
    near = (F.col("pos") - F.col(SEGMENT) * size < ahead) & (F.col(SEGMENT) > 0)
    copies = F.when(near, F.array(F.col(SEGMENT), F.col(SEGMENT) - 1)).otherwise(F.array(F.col(SEGMENT)))
    spread = rows.withColumn(SEGMENT, F.explode(copies)).withColumn(
        "segment_end", (F.col(SEGMENT) + 1) * size).withColumn("is_first", F.col(SEGMENT) == 0)
    cols = ["document_id", SEGMENT, "pos", "is_heading", "is_table", "path_key", "tokens", "segment_end"]
    long = rows.where(F.col(SEGMENT) > 0).select("document_id").distinct()

    first = spread.where("is_first").select(*cols, F.lit(1).cast("long").alias("entry"))
    many = spread.join(long, "document_id", "left_semi").select(*cols, "is_first")
    exits = _sorted(many).mapInPandas(segment_exits(limits), EXITS)
    entries = (
        exits.repartition("document_id").sortWithinPartitions("document_id", SEGMENT, "low")
        .mapInPandas(segment_entries, "document_id string, __segment long, entry long")).where(F.col(SEGMENT) > 0)
    later = many.where("not is_first").join(entries, ["document_id", SEGMENT]).select(*cols, "entry")
    members = _sorted(first.unionByName(later)).mapInPandas(segment_members(limits), MEMBERS)
    members = materialise(members, "chunk-members")

    heads = members.select("document_id", SEGMENT, "start", "part").distinct()
    numbered = scan(heads, ["document_id"], SEGMENT, ["start", "part"],
                    sums={"chunk_ordinal": F.lit(1)}, leads={"after": F.lit(True)})
    numbered = numbered.withColumn("has_next", F.col("after").isNotNull()).drop("after")
    return (members.join(numbered, ["document_id", SEGMENT, "start", "part"])
            .join(rows.select("document_id", "pos", "ordinal"), ["document_id", "pos"])
            .select("document_id", F.col("chunk_ordinal").cast("long").alias("chunk_ordinal"), "has_next", "pos", "ordinal"))


def _sorted(df: DataFrame) -> DataFrame:
    return df.repartition("document_id", SEGMENT).sortWithinPartitions("document_id", SEGMENT, "pos")


def chunks(blocks: DataFrame, policies: DataFrame | None = None, titles: DataFrame | None = None,
           limits: C.ChunkLimits = C.ChunkLimits(), blocks_per_segment: int = BLOCKS_PER_SEGMENT) -> DataFrame:
    """C-02 .. C-12: blocks to finished chunks.

    ``policies``: source_id, authority_tier, retrieval_tier, currency_status.
    ``titles``: document_id, title. Documents without a policy are left out
    here; ``missing_policy`` lists them for the ledger.
    """
    kept = substantive(blocks)
    if policies is not None:
        kept = kept.join(policies.select("source_id", F.struct(
            "authority_tier", "retrieval_tier", "currency_status").alias("source_policy")), "source_id")
    else:
        kept = kept.withColumn("source_policy", F.lit(None).cast(
            "struct<authority_tier:string,retrieval_tier:string,currency_status:string>"))
    members = chunk_members(kept, limits, blocks_per_segment)
    rows = members.join(kept, ["document_id", "ordinal"])
    if titles is not None:
        rows = rows.join(titles.select("document_id", "title"), "document_id", "left")
    else:
        rows = rows.withColumn("title", F.lit(None).cast("string"))

    pos = F.col("pos")
    body = F.col("block_type") != "heading"
    grouped = rows.groupBy("document_id", "chunk_ordinal").agg(
        F.first("has_next").alias("has_next"),
        F.first("source_id").alias("source_id"), F.first("source_hash").alias("source_hash"),
        F.first("source_policy").alias("source_policy"), F.first("title").alias("title"),
        X.ordered_list(F.col("block_id"), pos).alias("block_ids"),
        X.ordered_list(F.col("block_type"), pos).alias("block_types"),
        F.coalesce(F.min_by(F.when(body, F.col("heading_path")), F.when(body, pos)),
                   F.max_by("heading_path", pos)).alias("heading_path"),
        X.ordered_text(X.strip(F.col("text")), pos, "\n\n").alias("evidence_text"),
        F.min_by("citation", pos).alias("__first"), F.max_by("citation", pos).alias("__last"),
        F.array_distinct(F.flatten(X.ordered_list(
            F.coalesce("citation.section_ids", F.array().cast("array<string>")), pos))).alias("__sections"),
    )
    heading = X.join_path(F.col("heading_path"))
    evidence = F.col("evidence_text")
    inner = F.when(F.lit(limits.prepend_heading) & (heading != ""),
                   F.concat(F.lit("Section: "), heading, F.lit("\n\n"), evidence)).otherwise(evidence)
    titled = F.concat(F.lit("title: "), F.coalesce("title", "document_id"), F.lit(" | text: "), inner)
    ordinal = F.col("chunk_ordinal")

    def chunk_id(n: Column) -> Column:
        return F.format_string("%s:c%04d", F.col("document_id"), n)

    out = grouped.withColumn("embedding_text", titled).withColumn(
        "estimated_evidence_tokens", X.token_count(evidence))
    return out.select(
        chunk_id(ordinal).alias("chunk_id"), F.lit(C.SCHEMA_VERSION).alias("schema_version"), "document_id", "source_id",
        "source_hash", ordinal.alias("chunk_ordinal"), "block_ids", "block_types", "heading_path", "evidence_text",
        X.sha256_tag(evidence).alias("evidence_text_sha256"), "embedding_text", "estimated_evidence_tokens",
        X.token_count(F.col("embedding_text")).alias("estimated_embedding_tokens"),
        merged_citation(F.col("__first"), F.col("__last"), F.col("__sections")).alias("citation"), "source_policy",
        F.when(ordinal > 1, chunk_id(ordinal - 1)).alias("previous_chunk_id"),
        F.when(F.col("has_next"), chunk_id(ordinal + 1)).alias("next_chunk_id"),
        F.when(F.col("estimated_evidence_tokens") > limits.hard, F.array(F.lit("single_block_exceeds_hard_limit")))
        .otherwise(F.array().cast("array<string>")).alias("chunking_flags"),
    )


def merged_citation(first: Column, last: Column, sections: Column) -> Column:
    """C-06."""
    parts = {f.name: first[f.name] for f in CITATION.fields}
    for end in ("pdf_page_end", "printed_page_end"):
        parts[end] = F.coalesce(last[end], first[end])
    parts["section_ids"] = sections
    return citation_of(**parts)


def missing_policy(blocks: DataFrame, policies: DataFrame) -> DataFrame:
    """C-03: documents whose source has no policy, with the reason."""
    lost = blocks.join(policies.select("source_id"), "source_id", "left_anti").groupBy("document_id").agg(
        F.first("source_id").alias("source_id"))
    return lost.withColumn("error", F.concat(F.lit("Missing source policy for "), F.col("source_id")))


def chunk_summary(blocks: DataFrame, chunked: DataFrame, limits: C.ChunkLimits = C.ChunkLimits()) -> DataFrame:
    """C-13."""
    base = substantive(blocks).groupBy("document_id").agg(F.count("*").alias("input_blocks"))
    out = chunked.groupBy("document_id").agg(
        F.count("*").alias("output_chunks"),
        F.max(F.coalesce(F.col("source_policy.retrieval_tier") == "historical_only", F.lit(False))).alias("historical_only"),
        F.count_if(F.size("chunking_flags") > 0).alias("chunks_over_hard_limit"))
    return base.join(out, "document_id", "left")
