"""Ranking within keys. ``row_number <= k`` lets Spark cut each task to k rows before the shuffle."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    require_positive(k=k)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, place).where(F.col(rank) <= k)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key. ``min_by`` combines before the shuffle, so many copies of a key stay cheap."""
    return _pick(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def _pick(df, keys, order, how):
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    place = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(how(row, place).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", accuracy: int = 10000) -> DataFrame:
    """The exact median per key, with no group held in one place.

    A quantile sketch with a known rank error brackets the middle; only equal
    values inside the bracket are counted and ranked.
    """
    if not keys:
        raise ValueError("exact_median needs at least one key")
    slack = 2.0 / accuracy
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    sketch = known.groupBy(*keys).agg(
        F.percentile_approx("__v", [max(0.0, 0.5 - slack), min(1.0, 0.5 + slack)], accuracy).alias("__b"),
        F.count("*").alias("__n"),
    )
    near = known.join(sketch, list(keys))
    lo, hi = F.col("__b")[0], F.col("__b")[1]
    below = near.groupBy(*keys).agg(
        F.count_if(F.col("__v") < lo).alias("__below"), F.first("__n").alias("__n")
    )
    counts = near.where(F.col("__v").between(lo, hi)).groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    ranked = counts.join(below, list(keys))
    upto = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("__end", F.col("__below") + F.sum("__c").over(upto))
    left, right = F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)
    return ranked.groupBy(*keys).agg(
        ((F.min(F.when(F.col("__end") >= left, F.col("__v"))) + F.min(F.when(F.col("__end") >= right, F.col("__v")))) / 2)
        .alias(out)
    )


def require_positive(**values) -> None:
    """T-17: limits must be positive."""
    for name, v in values.items():
        if v is None or v <= 0:
            raise ValueError(f"{name} must be positive")


def require_between(low: float, high: float, **values) -> None:
    for name, v in values.items():
        if not low <= v <= high:
            raise ValueError(f"{name} must lie between {low} and {high}")


def split_blank(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """T-17 for a batch: (usable rows, rejected rows with a reason)."""
    from ..functions.text import is_blank

    blank = is_blank(F.col(text))
    return df.where(~blank), df.where(blank).withColumn("reason", F.lit("blank query"))


def parameter_rejects(requests: DataFrame) -> DataFrame:
    """T-17 for a batch whose requests bring their own limits: the requests that cannot be run, and why.

    ``requests``: query_text, k, alpha and others; the reasons are those that ``require_positive`` and ``require_between`` give.
    """
    from ..functions.text import is_blank

    reasons = F.array_compact(F.array(
        F.when(is_blank(F.col("query_text")), "blank query"),
        F.when(F.coalesce(F.col("k") <= 0, F.lit(True)), "k must be positive"),
        F.when(~F.coalesce(F.col("alpha").between(0.0, 1.0), F.lit(False)), "alpha must lie between 0.0 and 1.0")))
    return requests.withColumn("reasons", reasons).where(F.size("reasons") > 0)
