"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and one equi-join
that adaptive execution may split, so a component with a third of all nodes is
not gathered in one task. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.runtime import cut, release


def _canonical(df: DataFrame) -> DataFrame:
    return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable, for each node with a link to another.

    Nodes are longs. Links may repeat, point either way, or join a node to
    itself (ignored); a link with a null end is ignored. Without links the
    result is empty.
    """
    edges = cut(_canonical(links.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    before = _mark(edges)
    if before[0]:
        for _ in range(rounds):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = _canonical(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = cut(_canonical(small.unionByName(least.select("u", F.col("m").alias("v")))))
            after = _mark(edges)
            release(links.sparkSession)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
