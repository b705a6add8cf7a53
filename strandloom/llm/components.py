"""Connected components of a table of links, by repeated contraction in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the least node that it is linked to, over any way.

    Each round gives every node the least of its neighbours, follows that once more, and
    replaces the ends of the links by it; links that became loops go.  Links and labels stay
    in tables; the driver only learns how many links are left.  most: a bound on the rows of ``links``, where one is known.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links", most)
    maps: list[DataFrame] = []
    first = 0
    while left := edges.count():
        first = first or left
        low = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
        low = low.select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        once = written(low, "parents", 2 * left)
        over = once.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = written(once.join(over, "up").select("node", F.col("top").alias("up")), "jumps", 2 * left)
        maps.append(jump)
        every = edges.unionByName(jump.where("node <> up").select(F.col("node").alias("a"), F.col("up").alias("b")))
        a, b = jump.select(F.col("node").alias("a"), F.col("up").alias("x")), jump.select(F.col("node").alias("b"), F.col("up").alias("y"))
        both = every.join(a, "a").join(b, "b").where("x <> y")
        edges = written(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links", 3 * left)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = maps[0].select("node", F.col("up").alias("label"))
    for m in maps[1:]:
        step = m.select(F.col("node").alias("label"), F.col("up").alias("next"))
        label = label.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return written(label, "labels", 2 * first) if len(maps) > 1 else label
