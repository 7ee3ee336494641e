"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is a handful of group-bys and joins on node; minima are combined before the shuffle, and the
minima are written before they are joined, so that Spark can split a node with very many links or broadcast
a small table of minima. Lineage is cut by tables in the shared folder. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected(links: DataFrame, folder: str) -> DataFrame:
    """links(u long, v long) -> (node, root): each linked node with the least node of its component, roots included."""
    now = common.written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), folder, "links-0")
    state, k = _state(now), 0
    while state[0]:
        k += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), folder, f"large-{k}")
        large = common.written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), folder, f"links-{k}-large")
        least = common.written(large.groupBy("u").agg(F.min("v").alias("m")), folder, f"small-{k}")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = common.written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), folder, f"links-{k}")
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
