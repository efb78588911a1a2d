"""Interval algebra: runs, merging, complements and coverage, as window functions.

``by`` names the columns that tell one sequence or set of ranges from another. Ranges are
half-open. Everything is one shuffle on ``by`` plus a sort, and streams within a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(covered: DataFrame, by: Sequence[str], min_len: Column | int, max_gap: Column | int, min_density: float, pos: str = "pos") -> DataFrame:
    """(by, start, end, n): stretches of distinct covered positions that bridge gaps of at most ``max_gap``.

    A stretch is kept from ``min_len`` on, and where at least ``min_density`` of it is covered.
    ``min_len`` and ``max_gap`` may be columns that are constant within ``by``.
    """
    w = Window.partitionBy(*by).orderBy(pos)
    gap = F.col(pos) - F.lag(pos).over(w) - 1
    marked = covered.withColumn("_new", F.when(gap <= max_gap, 0).otherwise(1)).withColumn("_least", F.lit(min_len) if isinstance(min_len, int) else min_len)
    islands = marked.withColumn("_run", F.sum("_new").over(w)).groupBy(*by, "_run").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.count(F.lit(1)).alias("n"), F.first("_least").alias("_least"))
    length = F.col("end") - F.col("start")
    return islands.filter((length >= F.col("_least")) & (F.col("n") / length >= min_density)).drop("_run", "_least")


def run_arrays(positions: Column, min_len: Column, max_gap: Column, min_density: float) -> Column:
    """``runs`` of one sorted array of positions, without a shuffle: array of (start, end, n).

    A run opens where the position before is too far and closes where the next one is, so
    neighbours are compared once each.
    """
    placed = F.transform(positions, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    far = lambda later, earlier: F.coalesce(later - earlier - 1 > max_gap, F.lit(True))
    opens = F.filter(placed, lambda x: far(x["p"], F.get(positions, x["i"] - 1)))
    closes = F.filter(placed, lambda x: far(F.get(positions, x["i"] + 1), x["p"]))
    found = F.zip_with(opens, closes, lambda o, c: F.struct(o["p"].alias("start"), (c["p"] + 1).alias("end"), (c["i"] - o["i"] + 1).alias("n")))
    return F.filter(found, lambda r: (r["end"] - r["start"] >= min_len) & (r["n"] / (r["end"] - r["start"]) >= min_density))


def merge(ranges: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """(by, start, end): overlapping or touching ranges as one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_group", F.sum("_new").over(w))
    return marked.groupBy(*by, "_group").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_group")


def complement(ranges: DataFrame, whole: DataFrame, by: Sequence[str], duration: str = "duration", sliver: float = 0.05) -> DataFrame:
    """(by, start, end): what the ranges leave of [0, duration], without pieces of ``sliver`` or less.

    ``whole`` has a row (by, duration) for each; ranges are clipped to it and empty ones
    don't count. A duration of 0 or less leaves nothing.
    """
    clipped = ranges.filter(F.col("end") > F.col("start")).join(whole.select(*by, F.col(duration).alias("_d")), list(by))
    clipped = clipped.select(*by, F.greatest(F.lit(0.0), "start").alias("s"), F.least("_d", "end").alias("e")).filter("e > s")
    # the end of the whole closes the last gap like a range that starts there
    closing = whole.filter(F.col(duration) > 0).select(*by, F.col(duration).cast("double").alias("s"), F.col(duration).cast("double").alias("e"))
    w = Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    gaps = clipped.unionByName(closing).withColumn("start", F.coalesce(F.max("e").over(w), F.lit(0.0)))
    return gaps.filter(F.col("s") - F.col("start") > sliver).select(*by, "start", F.col("s").alias("end"))


def saved_seconds(ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, saved): length of the union of ranges."""
    merged = merge(ranges.filter(F.col("end") > F.col("start")), by)
    return merged.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("saved"))


def covered(spans: DataFrame, parts: DataFrame, by: Sequence[str], tol: float, start: str = "start", end: str = "end") -> DataFrame:
    """``by`` of the spans that the union of their parts covers, leaving no gap wider than ``tol``.

    ``spans`` has one row (by, start, end) each, ``parts`` any number of rows (by, part_start,
    part_end). A span no longer than ``tol`` without a later part is covered.
    """
    both = spans.select(*by, F.col(start).alias("_s"), F.col(end).alias("_e")).join(parts.select(*by, "part_start", "part_end"), list(by), "left")
    w = Window.partitionBy(*by).orderBy(F.col("part_start").asc_nulls_first(), "part_end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("_s"), F.coalesce(F.max("part_end").over(w), F.col("_s")))
    # a part that ends before what is reached is passed over; one that starts beyond the tolerance ends the walk, unless the goal was reached before
    ahead = (F.col("part_end") > reached) & (F.col("part_start") > reached + tol)
    failed = ahead & ((reached < F.col("_e") - tol) | (reached == F.col("_s")))
    judged = both.withColumn("_failed", F.coalesce(failed, F.lit(False)))
    final = F.greatest(F.max("_s"), F.coalesce(F.max("part_end"), F.max("_s")))
    return judged.groupBy(*by).agg((~F.bool_or("_failed") & (final >= F.max("_e") - tol)).alias("_covered")).filter("_covered").drop("_covered")


def ending(ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, until): a second past the last range."""
    return ranges.groupBy(*by).agg((F.coalesce(F.max("end"), F.lit(0.0)) + 1.0).alias("until"))
