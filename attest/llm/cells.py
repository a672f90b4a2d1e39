"""Rows that share a band value, dealt into cells of a bounded size in which every two of them meet once."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, released

KEYS = ("band", "key", "i", "j")


def deal(banded: DataFrame, block: int) -> DataFrame:
    """node, band, key, i, j and left from rows (node, band, key); values that a single node has are left out.

    The nodes of a value are split by a hash into blocks of about `block`; block i meets every block j >= i in a cell of
    its own. `left` tells which of the two a row belongs to; in a cell of one block (i = j) all are left.
    """
    sizes = banded.groupBy("band", "key").count().filter("count > 1")
    cells = materialise(sizes.select("band", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "cells")
    dealt = banded.join(cells, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = materialise(dealt.select("node", "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                                     (F.col("own") <= F.col("other")).alias("left")), "dealt")
    released(cells)
    return dealt


def gathered(dealt: DataFrame, payload: DataFrame) -> DataFrame:
    """The dealt rows with the payload of their node, whole cells in one partition and one behind the other."""
    return dealt.join(payload, "node").repartition(*KEYS).sortWithinPartitions(*KEYS, "node")


def whole(batches: Iterator[pa.RecordBatch], least: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole cells, of `least` rows or more but for the last; more only where one cell has more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(size, bool)  # rows of the last cell, which may go on
        for name in KEYS:
            column = rows[name].to_numpy()
            last &= column == column[-1]
        cut = 0 if last.all() else size - int(last[::-1].argmin())
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        held = rows.slice(cut).to_batches()
        size -= cut
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def starts(rows: pa.Table) -> np.ndarray:
    """Where the cells begin."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in KEYS:
        column = rows[name].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)
