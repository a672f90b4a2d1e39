"""Connected components of links between numbers, by alternating small-star and large-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise

ROUNDS = 40


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node it is linked to, of every node but the roots.

    edges: columns a and b (long); nulls and loops are left out. Every round hooks each node below its smallest
    neighbour and each tree below its parent's parent, so paths at least halve. A node with many neighbours is never
    gathered: least values combine before the shuffle and joins may split a hot key. Rounds are written to the shared
    folder, which cuts the lineage.
    """
    links = materialise(edges.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small"))
                        .filter("a is not null and b is not null and a <> b").distinct(), "links")
    for _ in range(ROUNDS):
        parents = materialise(links.groupBy("big").agg(F.min("small").alias("parent")), "parents")
        if links.count() == parents.count():
            # Every node has one parent; the trees are stars if no parent has one.
            if parents.join(parents.select(F.col("big").alias("parent")), "parent", "left_semi").isEmpty():
                return parents.select(F.col("big").alias("node"), F.col("parent").alias("root"))
            hooked = links
        else:
            hooked = materialise(
                links.join(parents, "big").filter("small <> parent").select(F.col("small").alias("big"), F.col("parent").alias("small"))
                .union(parents.select("big", F.col("parent").alias("small"))).distinct(), "hooked")
            parents = materialise(hooked.groupBy("big").agg(F.min("small").alias("parent")), "parents")
        above = parents.select(F.col("big").alias("small"), "parent")
        links = materialise(
            hooked.join(above, "small", "left").select("big", F.coalesce("parent", "small").alias("small"))
            .union(parents.select("big", F.col("parent").alias("small"))).distinct(), "links")
    raise RuntimeError(f"no components after {ROUNDS} rounds")
