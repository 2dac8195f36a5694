"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the link table; the links are written
to the shared folder after each round. Rounds grow with the logarithm of the
longest chain. No component is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.shared import dropped, kept

MOST_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """links: a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return joined.unionByName(least.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of links(a, b); component is the smallest node.

    Null ends and loops are dropped; a node that only has a loop is not returned.
    """
    now = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    now = kept(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(now)
    for _ in range(MOST_ROUNDS):
        if before[0] == 0:
            break
        last, now = now, kept(_small_star(_large_star(now)).distinct(), "links")
        dropped(last)  # what follows reads the new table only
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
