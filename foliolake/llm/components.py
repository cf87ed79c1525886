"""Connected components of a link table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def with_least(rows: DataFrame, many: int) -> DataFrame:
    """``u, v`` with ``m``, the least ``v`` of each ``u``.

    A node with more than ``many`` rows is a hub.  All hubs together have no more rows than there are, so their number is
    bounded by rows / many; they are broadcast, and their rows stay where they are.
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    met = rows.join(F.broadcast(least.filter(F.col("n") > many).select("u", "m")), "u", "left")
    rest = met.filter("m IS NULL").select("u", "v").join(least.filter(F.col("n") <= many).select("u", "m"), "u")
    return met.filter("m IS NOT NULL").unionByName(rest)


def components(links: DataFrame, most_rounds: int = 60, most_hubs: int = 1024) -> DataFrame:
    """``id, component`` for every id in ``links`` (two long columns); the component is the smallest id reachable.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to the larger ones, then to the
    smaller ones.  Rounds grow with the logarithm of the longest path.  Smallest neighbours are partial aggregates, and at
    most ``most_hubs`` hubs are broadcast, so no task meets all rows of a hub.
    """
    a, b = links.columns[:2]
    edges = written(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark, many = None, max(64, 2 * edges.count() // most_hubs)
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met = with_least(both, many).withColumn("m", F.least("u", "m"))
        large = met.filter("v > u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Now every row points down, so the smaller neighbours of u are its v.
        down = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        new = written(with_least(large, many).select(down.alias("e")).select("e.*").filter("u != v").distinct(), "edges")
        discard(edges)
        edges = new
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    # Each u now has one v, its component's smallest id.
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
