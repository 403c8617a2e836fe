"""Connected components of a table of links, for chains and for stars of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.store import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links(u, v)``: the least id reachable from it.

    Each round points every id and all its neighbours to the least id among them (large star, then small
    star), which takes a number of rounds logarithmic in the longest chain.  The minimum of a star is
    aggregated partially before the shuffle; rounds are cut by written tables.  Nothing but two counters
    comes to the driver.
    """
    edges = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour of u to the least id near u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # ids without a smaller neighbour keep the link to themselves only
        large = large.distinct()
        # small star: u and its smaller neighbours to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "links")
        state = tuple(fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        dropped(edges)
        edges = fresh
        if state == before:
            break
        before = state
    own = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own)
