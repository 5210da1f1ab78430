"""Connected components by alternating stars, each step one shuffled join over the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) to the smallest neighbour: of the larger neighbours (large star), or of a node itself and
    its smaller neighbours (small star)."""
    if large:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        made = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        made = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    return made.where("a <> b").distinct()


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link, from links (a, b); component is the smallest node it reaches.

    A node may have any number of links: minima are aggregated before the shuffle, and joins on a hot node are
    plain equi-joins that adaptive execution splits. Steps are written to the shared folder; the one before is deleted.
    """
    links = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    while (now := _state(links)) != before and now[0]:
        before = now
        step = materialise(_star(_star(links, True), False), "links")
        discard(links)
        links = step
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select("b", "b").distinct())
