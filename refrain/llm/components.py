"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; a hub's links are combined before the shuffle and
its join partition may be split at run time. Every round is written to the shared folder, so
a lost executor repeats one round at most. Rounds grow with the logarithm of the longest path.

Defined results: links of a node with itself and repeated links say nothing; a link with a
null end is dropped; an empty table has no components. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.sources.shared import discard, materialize


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that isn't its component's smallest; root is that smallest."""
    links = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        old, links = links, materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(old)
        before, state = state, _state(links)
        if before == state:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
