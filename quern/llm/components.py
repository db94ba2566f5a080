"""Connected components of a graph given as a table of edges.

Large-star and small-star steps in turn: each node's larger neighbours, then its smaller ones, are
linked to the smallest node next to it, until every edge leads to its component's smallest node.
Minima are aggregated before they are shuffled and joined back, so a node with very many edges is
not gathered in one task. Each round is written to the shared folder, which ends the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import drop_table, table


def _star(directed: DataFrame) -> DataFrame:
    """(u, v) to (u, v, m), m the smallest of u and its v."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, component) for every node of an edge between two different nodes; the
    component is its smallest node. Nulls and loops are left out. The result is a table."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u > v").distinct()
    e = table(e, "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small = _star(large)
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        out = table(out, "edges")
        drop_table(e)
        e = out
        chained = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if e.groupBy("u").count().filter("count > 1").isEmpty() and chained.isEmpty():
            break
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = table(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    drop_table(e)
    return out
