"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchpulse.llm.common import stored


def _neighbours(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = _neighbours(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = both.where("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    found = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head()
    return tuple(found)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links`` (a, b), the component being its smallest node.

    Each round is written to the shared folder, so no lineage grows; the number of
    rounds is logarithmic in the longest chain. Nodes without a link are not listed.
    """
    now = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    state = _state(now)
    while True:
        now = stored(_small_star(_large_star(now)), "links")
        if (after := _state(now)) == state:
            break
        state = after
    tops = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(tops)
