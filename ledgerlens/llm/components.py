"""Connected components by alternating star contraction.

Each round hangs every node on the least node of its neighbourhood (large star:
the larger neighbours; small star: the rest).  The minimum is a pre-aggregated
``groupBy``; a node with very many neighbours is then met by a join, whose hot
partitions Spark splits, and never by collecting its neighbours.  A round is
written to the shared folder, so the lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize

MAX_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple:
    low = F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(low)).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (``a``, ``b``) to ``(node, root)``: for every node that has a
    link to another, the least node of its component (roots themselves are left
    out).  Repeated links, links in both directions and links of a node to
    itself are allowed; links with a null end are dropped."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ends = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    edges = materialize(links.filter(ends).select(u, v).distinct(), "edges")
    before = _digest(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (edges.select(F.col("v").alias("u"), F.col("u").alias("x")).join(least, "u")
                 .select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialize(low.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "edges")
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
