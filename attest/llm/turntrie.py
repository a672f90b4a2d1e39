"""A prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Peeling begins at the greatest depth: conversations that end there meet the
nodes that survived from below, equal sequences merge, every node gives its sums to the level above by losing its last
turn, and so each node is found and aggregated in one pass. What only one sequence of turns reaches is a chain without
branches; it needs no level of its own but running sums, so the passes number the turns that unlike conversations share,
not the turns of the longest one.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordered import scan, segment_of
from .common import materialise, table

SEGMENT = 4096  # turns of a conversation that one window holds, and ids that one list holds
ROOT = b""  # names the node without turns
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), h1, h2 (hashes of role and text) and bytes (UTF-8, of the text) of every turn.

    Turns are ordered by turn (null first), then role and text; a null role or text is empty, repeated rows are turns of
    their own. Rows without a conv_id belong to no conversation and are left out. Long conversations are numbered in segments.
    """
    long = F.col("turn").cast("long")
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), long.alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(segment_of(long, SEGMENT), F.lit(-(1 << 62))).alias("part"))
    placed = scan(rows, ["conv_id"], "part", ["turn", "role", "text"], sums={"place": F.lit(1).cast("long")})
    return placed.select("conv_id", "place", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"),
                         F.octet_length("text").cast("long").alias("bytes"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node (what names the turns up to here) and done (their bytes) of every turn.

    The name comes from two sums of hashes of (place, turn), so that long conversations are named in segments, too.
    """
    wide = [F.xxhash64(F.lit(i), F.col("place"), F.col("h1"), F.col("h2")).cast("decimal(20,0)") for i in range(2)]
    rows = turns.select("*", segment_of(F.col("place") - 1, SEGMENT).alias("part"))
    summed = scan(rows, ["conv_id"], "part", ["place"], sums={"s1": wide[0], "s2": wide[1], "done": F.col("bytes")})
    return summed.select("conv_id", F.col("place").alias("depth"), F.unhex(F.md5(F.concat_ws(":", "place", "s1", "s2").cast("binary"))).alias("node"), "bytes", "done")


def _ends(ended: DataFrame) -> DataFrame:
    """node and ends_sha256 of the nodes where conversations end: rows (conv_id, node).

    Ids are put in order and joined in lists of a bounded range of ids; one task then reads a node's lists in order and
    keeps only the state of the digest.
    """
    lists = ended.groupBy("node", F.floor(F.col("conv_id") / SEGMENT).cast("long").alias("part")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids")) \
        .select("node", "part", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()))
        out: list[tuple[bytes, str]] = []
        for node, own in groupby(rows, key=lambda r: r[0]):
            h = hashlib.sha256(next(own)[1].encode())
            for _, ids in own:
                h.update(f",{ids}".encode())
            out.append((node, h.hexdigest()))
            if len(out) == 10_000:
                yield _record(out)
                out = []
        if out:
            yield _record(out)

    def _record(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])

    return lists.repartition("node").sortWithinPartitions("node", "part").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def _last(path: Column | str, depth: int) -> Column:
    return F.element_at(path, depth)["node"] if depth else F.lit(ROOT)


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations: the columns NODES, one row for each node, the root among them.

    turns: rows as of `numbered`, places from 1 on without a gap; members: conv_id of all conversations, also those without
    a turn. Every node's conv_id is its smallest member, n_convs counts members, n_leaves the childless nodes of its
    subtree, and saved_tokens sums (n_convs - 1) * bytes of the last text over its subtree. Without conversations there is no
    node. Equal conversations count as one sequence from the start, so a large group of copies is one row; sums combine
    before they are shuffled.
    """
    paths = materialise(_prefixes(turns), "trie-prefixes")
    reach = paths.groupBy("conv_id").agg(F.max_by(F.struct("depth", "node", "done"), "depth").alias("end"))
    ended = materialise(members.select("conv_id").distinct().join(reach, "conv_id", "left").select(
        "conv_id", F.coalesce("end.node", F.lit(ROOT)).alias("node"), F.coalesce("end.depth", F.lit(0)).alias("length"), F.coalesce("end.done", F.lit(0)).alias("total")), "trie-ends")
    # One conversation stands for all that are equal.
    sequences = materialise(ended.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("length").alias("length"),
                                                      F.first("total").alias("total")).drop("node"), "trie-sequences")
    rows = paths.join(sequences.select("conv_id"), "conv_id", "left_semi")
    shared = materialise(rows.groupBy("node").count().filter("count > 1").select("node", F.lit(True).alias("shared")), "trie-shared")
    rows = materialise(rows.join(shared, "node", "left").select("conv_id", "depth", "node", "bytes", "done", F.coalesce("shared", F.lit(False)).alias("shared")), "trie-rows")
    step = F.struct("depth", "node", "bytes", "done")
    common = rows.filter("shared").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("path"))
    below = F.col("length") > F.size("path")  # the sequence goes on alone
    rest = (F.col("n") - 1) * (F.col("total") - F.coalesce(F.try_element_at("path", F.lit(-1))["done"], F.lit(0)))
    none = F.array().cast("array<struct<depth: bigint, node: binary, bytes: bigint, done: bigint>>")
    entries = sequences.join(common, "conv_id", "left").withColumn("path", F.coalesce("path", none))
    entries = materialise(entries.select(
        "conv_id", "n", "length", "total", "path", F.size("path").alias("depth"), below.cast("long").alias("children"), below.cast("long").alias("leaves"),
        F.when(below, rest).otherwise(0).alias("saved")), "trie-entries")
    top = entries.agg(F.max("depth")).first()[0]
    levels: list[DataFrame] = []
    given = ("path", "conv_id", "n", "children", "leaves", "saved")
    for depth in range(-1 if top is None else top, -1, -1):
        meet = entries.filter(F.col("depth") == depth).select(*given)
        if levels:  # those of below without their last turn
            meet = meet.union(levels[-1].select(F.slice("path", 1, depth), "conv_id", "n", F.lit(1).cast("long"), "leaves", "saved"))
        merged = meet.groupBy(_last("path", depth).alias("node")).agg(
            F.first("path").alias("path"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("children").alias("children"),
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        own = (F.col("n") - 1) * F.element_at("path", depth)["bytes"] if depth else F.lit(0)
        levels.append(materialise(merged.select(
            "node", "path", "conv_id", "n", "children", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).alias("leaves"),
            (F.col("saved") + own).alias("saved"), F.lit(depth).cast("long").alias("depth"),
            (_last("path", depth - 1) if depth else F.lit(None).cast("binary")).alias("parent")), f"trie-level-{depth}"))
    found = ["node", "conv_id", "depth", "parent", "n", "children", "leaves", "saved"]
    alone = rows.filter("not shared").join(entries.select("conv_id", "n", "length", "total", F.size("path").alias("from"),
                                                          F.coalesce(F.try_element_at("path", F.lit(-1))["node"], F.lit(ROOT)).alias("above")), "conv_id")
    chains = alone.select(
        "node", "conv_id", "depth", F.when(F.col("depth") == F.col("from") + 1, F.col("above")).alias("parent"), "n", (F.col("depth") < F.col("length")).cast("long").alias("children"),
        F.lit(1).cast("long").alias("leaves"), ((F.col("n") - 1) * (F.col("total") - F.col("done") + F.col("bytes"))).alias("saved"))
    nodes = reduce(DataFrame.union, [level.select(*found) for level in levels], chains.select(*found))
    parents = reduce(DataFrame.union, [level.select(F.col("node").alias("parent"), F.col("conv_id").alias("of")) for level in levels]) if levels else \
        nodes.select("parent", F.col("conv_id").alias("of")).limit(0)
    # A node on a chain has its own conversation above it.
    over = F.when(F.col("depth") == 0, F.lit(None).cast("long")).otherwise(F.coalesce("of", "conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(parents, "parent", "left").join(_ends(ended.select("conv_id", "node")), "node", "left").select(
        "conv_id", "depth", over.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are: rows (conv_id, turn, role, text); see `numbered` and `trie`."""
    turns = materialise(numbered(conversations), "turns")
    return trie(turns, turns.select("conv_id"))


FAMILY = 5  # conversations that take their first turns from one of them
HEADS = 9  # one more than the turns that may be taken


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and members of rebuilt conversations: conversation c begins with the first h turns of conversation c - c % 5.

    h is the unsigned CRC-32 of the decimal c modulo 9; all turns if there are fewer, none if that conversation is absent. Its own
    turns after the first h follow, if any. For a negative c the remainder is that of the next lower multiple of five.
    """
    counts = materialise(turns.groupBy("conv_id").agg(F.max("place").alias("n")), "turn-counts")
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(FAMILY))
    plan = counts.select("conv_id", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).alias("h"), base.alias("base")) \
        .join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left") \
        .select("conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    plan = materialise(plan, "rebuild-plan")
    own = turns.join(plan, "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "h1", "h2", "bytes")
    heads = turns.filter((F.pmod(F.col("conv_id"), F.lit(FAMILY)) == 0) & (F.col("place") < HEADS)) \
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FAMILY - 1).cast("long")))) \
        .select(F.try_add("conv_id", "k").alias("conv_id"), "place", "h1", "h2", "bytes")
    taken = heads.join(plan, "conv_id").filter("place <= h").select("conv_id", "place", "h1", "h2", "bytes")
    return own.union(taken), plan.select("conv_id")


def op11_turntrie(spark: SparkSession, d: str) -> DataFrame:
    """The trie of all rebuilt conversations, one row for each node; see `numbered`, `rebuilt` and `trie`.

    Rows without a conv_id belong to no conversation; null turns come first, null roles and texts are empty, repeated rows are turns,
    texts of any length are hashed whole, and no conversations give no rows.
    """
    turns = materialise(numbered(table(spark, d, "conversations")), "turns")
    return trie(*rebuilt(turns))
