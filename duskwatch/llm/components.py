"""Connected components of links between 64-bit ids by alternating large and small stars.

The least neighbour of each id is stored before it is joined: so both sides of the join are plain tables, and Spark may
split an id that very many links share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """From links (u, v) of long ids to (id, root) for every id that has a link; root is the smallest id."""
    links = stored(links.filter("u <> v"), "links")
    before = _state(links)
    while before[0]:
        links = stored(_small_star(stored(_large_star(links), "stars")), "links")
        now = _state(links)
        if now == before:
            break
        before = now
    member = links.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return member.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
