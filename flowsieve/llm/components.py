"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, files_for, salted_join


def components(links: DataFrame, space: Workspace, tag: str = "cc") -> DataFrame:
    """(id, component) of every id in ``links`` (u, v); the component is its lowest id.

    Links stay in tables, higher id first; the rounds end when the table no longer changes. A star of any size is a
    minimum, combined before the shuffle, and a join whose hubs are dealt over many tasks, never a list of neighbours.
    ``links`` is read more than once: give a table."""
    edges, mark, n = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), None, 0
    total = links.count()  # links never get more
    edges = space.write(edges, f"{tag}0", files_for(total))
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark, n = seen, n + 1
        # large star: the higher neighbours of an id, and itself, go to the lowest of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        higher = salted_join(both.filter("v > u"), low, "u", "v", seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = space.write(higher.unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))), f"{tag}large{n}", files_for(seen[0]))
        # small star: the lower neighbours of an id, and itself, go to the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = salted_join(large, low, "u", "v", seen[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = space.write(lower.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{tag}{n}", files_for(seen[0]))
        space.drop(f"{tag}large{n}")
        space.drop(f"{tag}{n - 1}")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
