"""Connected components by alternating stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, staged


def _small(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_counted(edges, low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours to its smallest neighbour, or to itself if it is the smallest."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return join_counted(both.filter("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of the links (a, b) of long ids; component is its smallest node.

    Stars alternate until the links no longer change; then all of a component's nodes
    hang on its smallest. No node's neighbours are gathered: minima are aggregated
    before the shuffle and joined back, those of nodes with very many neighbours by
    broadcast. Links to oneself and nulls are ignored."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now, last = staged(now, name), None
    while True:
        n, s = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if (n, s) == last or not n:
            break
        last = (n, s)
        now = staged(_small(_large(now)), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
