"""Connected components of a table of links, by alternating stars.

Each round lets every vertex's neighbours point to the smallest vertex around
it, first the larger ones, then the smaller ones; groups collapse to stars in
a number of rounds that grows with the logarithm of their diameter. A round is
two shuffles of the links, written to the shared folder; the driver sees only
whether anything changed. A hub's links are reduced by its minimum before they
are shuffled and joined back under adaptive execution, which splits hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.storage import discard, settled


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links (a, b) of each vertex ``a``; ``larger`` moves its larger neighbours to its minimum, else itself and its smaller ones."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "_a")
    near = both.join(least, both["a"] == least["_a"])
    if larger:
        moved = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(v, c): every vertex that has a link, and the smallest vertex it is connected with. ``links`` has a and b."""
    now = settled(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    digest = None
    for _ in range(limit):
        # first away from larger vertices, then towards the smallest
        out = _star(now, larger=True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        before, now = now, settled(_star(out, larger=False), "links")
        discard(before)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == digest:
            return now.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
        digest = tuple(sums)
    raise RuntimeError("links did not settle into components")
