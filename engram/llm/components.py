"""Connected components of a link table, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import settled


def least_neighbours(both: DataFrame) -> DataFrame:
    """u, m: the least of a node and its neighbours; counted per task before the shuffle."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected(links: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """node, root: the least node reachable from each node that has a link.

    Large stars hang a node's greater neighbours on its least neighbour, small
    stars the others; after some rounds, logarithmic in the longest path as a
    rule, every component is one star. Each round is written to the shared
    folder. Links of a node with itself and nulls are left out, repeated links
    count once, no links give no rows.
    """
    edges = settled(
        links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least_neighbours(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = settled(small.distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
    raise RuntimeError("components did not settle")
