"""Connected components of an edge table, without gathering anything on the driver.

Alternating large-star and small-star steps: every node's neighbours are linked to the smallest of them, until the
edges no longer change; then each node is linked straight to its component's smallest node.  Each round shortens a path
to a fraction, and edges always get smaller or fewer, so it ends however long the paths are.  Minima are aggregated
before they shuffle and written down, so that the join that spreads them has two plain inputs and Spark can split a node of
very many edges.  A round's tables are removed when the next is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import state


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v.  Large: each node's larger neighbours, small: its smaller ones and itself, go to its minimum.  Kept."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = state.keep(both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.col("n")).alias("m")), "least")
        out = both.where("v > u").join(least.hint("merge"), F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = state.keep(edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), "least")
        out = edges.join(least.hint("merge"), F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionAll(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    out = state.keep(out.where("u != v").distinct(), "edges")
    state.release(edges.sparkSession, edges, least)
    return out


def connected(links: DataFrame) -> DataFrame:
    """links (a, b), in any order and repeated at will -> node, component (its smallest node) for all linked nodes; kept."""
    spark = links.sparkSession
    with state.steps(spark) as outlives:
        edges = state.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
        before = _mark(edges)
        while before[0]:
            edges = _star(_star(edges, True), False)
            after = _mark(edges)
            if after == before:
                break
            before = after
        nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        found = state.keep(nodes, "components")
        outlives(found)
    return found
