"""Connected components of a table of links, by alternating star operations.

Every round replaces the links of a node by links to its smallest neighbour
(first from its larger neighbours, then from its smaller ones), until nothing
changes; the forest is then one star per component.  All steps are grouped
minima and joins; each round's links are written to the shared folder, and
only their count and checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoflow.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b); component is its smallest node."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = materialize(edges, "links")
    before = _state(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    inner = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return inner.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the least of the node and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("least_b"))
    # a node's larger neighbours are the a of rows whose b it is; its minimum is over both sides
    joined = edges.join(least.select(F.col("a").alias("b"), "least_b"), "b", "left")
    return joined.select("a", F.coalesce("least_b", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least_b"))
    joined = edges.join(least, "a")
    inner = joined.filter("b <> least_b").select(F.col("b").alias("a"), F.col("least_b").alias("b"))
    return inner.unionByName(least.select("a", F.col("least_b").alias("b"))).distinct()
