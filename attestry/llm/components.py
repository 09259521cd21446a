"""Connected components by alternating star contraction: links shrink towards the smallest id of their component, in
rounds that are written to the shared folder; nothing but two numbers a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import cut, release


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on the smallest of its neighbourhood and itself."""
    both = _both(e)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the smallest of them. Links have a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    hung = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node that a link joins to another; label is the smallest node of the component.

    links: columns a, b, bigint; self-links, repeated and NULL links are ignored. Minima are folded map-side and every
    join has one row per node on one side, so hubs are split by AQE. Rounds grow with the logarithm of the longest
    chain; the end is told by a count and a sum of hashes of the links.
    """
    e = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        nxt = cut(_small_star(_large_star(e)))
        now = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        release(e)
        e = nxt
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
