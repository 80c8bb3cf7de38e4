"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped minima and joins (node, minimum); nothing is collected, and a node with very many
neighbours only meets its minimum in a join that adaptive execution can split. Rounds are written to the shared
folder, so a lost executor never replays more than one of them; what tells whether a round changed anything is counted while
it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from forcemap.session import shuffled, staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.join(shuffled(least, 2 * rows), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(shuffled(least, rows), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def _written(edges: DataFrame, label: str) -> tuple[DataFrame, dict]:
    """The edges, written, and their number and the sum of their hashes."""
    mark = Observation()
    hashes = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    return staged(edges.observe(mark, F.count(F.lit(1)).alias("n"), hashes.alias("s")), label), mark.get


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that ``edges`` (u, v) mention; the root is the smallest node of its component."""
    now, mark = _written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while mark["n"] and mark != seen:
        seen = mark
        now, mark = _written(_small_star(_large_star(now, mark["n"]), 2 * mark["n"]), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
