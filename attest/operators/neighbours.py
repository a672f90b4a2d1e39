"""Neighbour expansion: the chunks around what a search found, without overlaps and within a number of tokens."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .topk import require_positive


def expand(found: DataFrame, chain: DataFrame, radius: int = 1, budget: int | None = None, rank: str = "rank") -> DataFrame:
    """query_id, document_id, chunk_ordinal, chunk_id, tokens, distance and found_rank of every chunk of the expanded result.

    ``found``: query_id, chunk_id and a rank. ``chain``: chunk_id, document_id, chunk_ordinal (from 0 or 1 on, without gaps), tokens.
    A chunk within ``radius`` of several results counts once, for the nearest and then the best one. With a budget, chunks are taken by
    distance, rank and place while the tokens of a query stay within it; the first that does not fit ends the list. The corpus is
    joined by (document, ordinal) with what is asked for, once.
    """
    require_positive(radius=radius + 1)
    if budget is not None:
        require_positive(budget=budget)
    places = found.select("query_id", "chunk_id", F.col(rank).alias("found_rank")).join(chain.select("chunk_id", "document_id", "chunk_ordinal"), "chunk_id")
    around = F.sequence(F.lit(-radius), F.lit(radius))
    near = places.select("query_id", "document_id", "found_rank", "chunk_ordinal", F.explode(around).alias("step")).select(
        "query_id", "document_id", (F.col("chunk_ordinal") + F.col("step")).alias("chunk_ordinal"), F.abs("step").alias("distance"), "found_rank")
    once = near.groupBy("query_id", "document_id", "chunk_ordinal").agg(F.min(F.struct("distance", "found_rank")).alias("b"))
    rows = once.join(chain.select("chunk_id", "document_id", "chunk_ordinal", "tokens"), ["document_id", "chunk_ordinal"]).select(
        "query_id", "document_id", "chunk_ordinal", "chunk_id", "tokens", "b.distance", "b.found_rank")
    if budget is None:
        return rows
    # A query has as many rows as results times the neighbourhood.
    upto = Window.partitionBy("query_id").orderBy("distance", "found_rank", "document_id", "chunk_ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__t", F.sum("tokens").over(upto)).where(F.col("__t") <= budget).drop("__t")


def intervals(expanded: DataFrame) -> DataFrame:
    """query_id, document_id, first and last ordinal, n_chunks, tokens and found_rank: neighbouring chunks of a query as one passage."""
    expanded = materialise(expanded, "expanded")
    place = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("chunk_ordinal"))
    island = expanded.withColumn("__i", F.col("chunk_ordinal") - place)
    return island.groupBy("query_id", "document_id", "__i").agg(
        F.min("chunk_ordinal").alias("first_ordinal"), F.max("chunk_ordinal").alias("last_ordinal"), F.count("*").alias("n_chunks"),
        F.sum("tokens").alias("tokens"), F.min("found_rank").alias("found_rank")).drop("__i")
