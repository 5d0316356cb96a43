"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node that it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("m", "a").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them. In every row a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    rest = edges.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node in links (a, b: long).

    Self-links and repeats are ignored; an empty table gives an empty one. Links stay in the executors; the driver sees a
    count and a checksum of each round. Each round is checkpointed, so lineage stays short and a lost executor is replaced.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        seen = now
        edges = checkpointed(_small(_large(edges).distinct()).distinct())
