"""Connected components of a table of links, with joins and aggregations.

Each round links every node's larger neighbours to its least neighbour, then
its smaller ones, until nothing changes. Rounds are written to the shared
folder; the number of rounds grows with the logarithm of the longest path.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.llm.frames import written


def mark(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component, the least node it reaches, for every node that has a link to another."""
    edges = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "links")
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        large = written(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("_m").alias("b"))).distinct(), "links")
        after = mark(edges)
        if after == before:
            break
        before = after
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
