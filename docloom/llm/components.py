"""Connected components of a link table, by alternating large and small stars.

Every step is a group-by and a join, so no component meets in one task; the number of
rounds grows with the logarithm of the longest path.  Nothing comes to the driver but
the count and checksum that tell when the links have stopped changing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: Links in a part of the table between two rounds.
PART = 50_000


def _stamp(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) of comparable ids -> (node, root), root the smallest id of the component.

    Links with a null or from a node to itself are ignored, repeated ones count once; ids without links have
    no row, so no links give an empty result."""
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    stamp = _stamp(links)
    while stamp[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("_a")).agg(F.least("_a", F.min("b")).alias("_least"))
        large = both.join(least, both["a"] == least["_a"]).where("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_least"))
        small = large.join(least, large["a"] == least["_a"]).where("b <> _least").select(F.col("b").alias("a"), F.col("_least").alias("b"))
        done, before = links, stamp
        links = cut(small.unionByName(least.select(F.col("_a").alias("a"), F.col("_least").alias("b"))).where("a <> b").distinct().coalesce(1 + before[0] // PART))
        stamp = _stamp(links)
        discard(done)
        if stamp == before:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
