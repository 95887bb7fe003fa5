"""Connected components over an edge table, by alternating stars.

Each round replaces a node's larger neighbours' links by links to its smallest
neighbour (large star), then does so for the smaller ones (small star), until the
links are stars around the smallest node of each component. Edges stay in the
cluster; a round's table is written to the shared folder, so a lost executor
costs no more than a round, and the driver sees one count and two sums. Rounds go on until nothing changes,
which takes some log(nodes) of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.common import cut, forget


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v: every u links its smaller neighbours, and itself, to the smallest."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component.

    ``edges`` has longs u and v; loops, repeats and both directions are fine, rows with nulls are not links.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        after = cut(_small_star(_large_star(now)), "stars")
        # xor of row hashes and the count: alike only if the links are
        new = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        forget(now)
        now = after
        if new == mark or not new[0]:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
