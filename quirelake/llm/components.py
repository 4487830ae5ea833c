"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.session import settle


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("of"), F.least("a", "least").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), F.col("a") == F.col("of")).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its lower neighbours are tied to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    tied = down.join(_least(down), F.col("a") == F.col("of"))
    return tied.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").unionByName(
        tied.select("a", F.col("least").alias("b"))
    ).distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node, root`` of every node of ``edges (a, b)``; ``root`` is the component's least node.

    Alternating star contraction: a logarithmic number of rounds, each of joins and
    groupings on nodes. A hub's links are only aggregated and joined, so its rows can
    be split. Each round is written to the shared folder, which cuts the lineage.
    """
    links = settle(_small_star(edges), label)
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        links = settle(_small_star(_large_star(links)), label)
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
