"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.frames import stored


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Links each neighbour (the larger ones, or the smaller ones and the node itself) with the least of all."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    rows = pairs.join(least, "u")
    if larger:
        out = rows.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = rows.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); the label is the component's least node.

    Self-links and repeated links change nothing; without links the result is
    empty.  Each round is written to the shared folder, so lineage stays short.
    """
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = None
    while True:
        row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(row) == mark or not row[0]:
            break
        mark = tuple(row)
        large = _star(_both(links), True)
        links = stored(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False), "links")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
