"""Ordered state over long groups, without giving one group to one task.

A group (a document) is cut into segments by a column that grows with the row
order. Each segment is scanned on its own; only one summary row per segment
travels on to the second pass, which hands every segment the state it starts
with. A group that holds a large share of all rows is thus spread over as many
tasks as it has segments.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

SEGMENT = "__segment"


def segment_of(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("long")


def numbered(df: DataFrame, order: Sequence[str], name: str = "no") -> DataFrame:
    """Rows with dense numbers from 0 on in the order of columns, sorted in ranges and never in one place.

    Rows are written out sorted, so that numbers stay as they are; only a count for each range is brought together.
    """
    rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__p").count().select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return rows.join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + within - 1).drop("__p", "__start")


def scan(
    df: DataFrame,
    part: Sequence[str],
    segment: str,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
    one_segment: bool = False,
) -> DataFrame:
    """Add running sums, running maxima, previous and next values per group.

    Rows are ordered by (segment, order) inside the group. Sums and maxima
    include the current row. Lags and leads are structs, so that a null value
    and a missing neighbour stay distinct: read them as ``col.v``.
    ``one_segment`` says that every group is known to fit one segment, because
    a group comes from a single input row; the second pass is then left out.
    """
    sums, maxes, lags, leads = dict(sums or {}), dict(maxes or {}), dict(lags or {}), dict(leads or {})
    keys = [*part, segment]
    inside = Window.partitionBy(*keys).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct(*[F.col(c) for c in order])

    local: dict[str, Column] = {}
    totals: list[Column] = []
    for name, c in sums.items():
        local[name] = F.sum(c).over(so_far)
        totals.append(F.sum(c).alias(name))
    for name, c in maxes.items():
        local[name] = F.max(c).over(so_far)
        totals.append(F.max(c).alias(name))
    for name, c in lags.items():
        local[name] = F.lag(F.struct(c.alias("v"))).over(inside)
        totals.append(F.max_by(F.struct(c.alias("v")), place).alias(name))
    for name, c in leads.items():
        local[name] = F.lead(F.struct(c.alias("v"))).over(inside)
        totals.append(F.min_by(F.struct(c.alias("v")), place).alias(name))

    if one_segment:
        return df.select("*", *[c.alias(n) for n, c in local.items()])

    across = Window.partitionBy(*part).orderBy(segment)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried: dict[str, Column] = {}
    for name in sums:
        carried[name] = F.sum(name).over(before)
    for name in maxes:
        carried[name] = F.max(name).over(before)
    for name in lags:
        carried[name] = F.lag(name).over(across)
    for name in leads:
        carried[name] = F.lead(name).over(across)

    summary = df.groupBy(*keys).agg(*totals)
    carry = summary.select(*keys, *[c.alias(f"__carry_{n}") for n, c in carried.items()])
    out = df.select("*", *[c.alias(f"__local_{n}") for n, c in local.items()]).join(carry, keys, "left")

    final = {}
    for name in sums:
        final[name] = F.coalesce(F.col(f"__local_{name}"), F.lit(0)) + F.coalesce(F.col(f"__carry_{name}"), F.lit(0))
    for name in maxes:
        final[name] = F.greatest(F.col(f"__local_{name}"), F.col(f"__carry_{name}"))
    for name in [*lags, *leads]:
        final[name] = F.coalesce(F.col(f"__local_{name}"), F.col(f"__carry_{name}"))
    return out.select(*df.columns, *[c.alias(n) for n, c in final.items()])


def dedup_adjacent(
    df: DataFrame, part: Sequence[str], segment: str, order: Sequence[str], key: Sequence[str], mark: str = "is_repeat", one_segment: bool = False
) -> DataFrame:
    """N-04: mark rows whose key equals that of the row before them."""
    now = F.struct(*[F.col(c) for c in key])
    marked = scan(df, part, segment, order, lags={"__before": now}, one_segment=one_segment)
    same = F.col("__before").isNotNull() & F.col("__before.v").eqNullSafe(now)
    return marked.withColumn(mark, F.coalesce(same, F.lit(False))).drop("__before")


def heading_stack(
    df: DataFrame,
    part: Sequence[str],
    segment: str,
    order: Sequence[str],
    level: str,
    heading: Column,
    heading_id: Column | None = None,
    *,
    max_level: int,
    sums: Mapping[str, Column] | None = None,
    one_segment: bool = False,
) -> DataFrame:
    """N-13: add ``heading_path`` and ``heading_ids`` of the open headings.

    A heading of level L closes every heading of level L or deeper. Level k is
    open exactly when its latest heading comes after the latest heading of
    every higher level, so running maxima of positions are all that is needed.
    ``max_level`` declares the deepest level; a deeper heading is an error.
    """
    place = F.struct(F.col(segment), *[F.col(c) for c in order])
    hid = heading_id if heading_id is not None else F.lit(None).cast("string")
    levels = range(1, max_level + 1)
    deep = F.raise_error(F.concat(F.lit(f"a heading is deeper than the declared level {max_level}: "), F.col(level).cast("string")))
    df = df.withColumn(level, F.when(F.col(level) > max_level, deep.cast("int")).otherwise(F.col(level)))
    latest = {
        f"__h{k}": F.when(F.col(level) == k, F.struct(place.alias("p"), heading.alias("h"), hid.alias("i")))
        for k in levels
    }
    scanned = scan(df, part, segment, order, sums=sums, maxes=latest, one_segment=one_segment)
    texts, ids = [], []
    for k in levels:
        here = F.col(f"__h{k}")
        open_ = here.isNotNull()
        for j in range(1, k):
            above = F.col(f"__h{j}")
            open_ = open_ & (above.isNull() | (above["p"] < here["p"]))
        texts.append(F.when(open_, here["h"]))
        ids.append(F.when(open_, here["i"]))
    return scanned.select(
        *df.columns,
        *(sums or {}),
        F.array_compact(F.array(*texts)).alias("heading_path"),
        F.array_compact(F.array(*ids)).alias("heading_ids"),
    )
