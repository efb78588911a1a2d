"""The matcher: seeds vote for alignments, alignments are verified, verified runs recur.

A stream is a row (scope..., file, idx, bits, item_sec, items). Only streams of one scope
(a folder) and one width meet. Votes are an equi-join on the seed key; from there on rows
are alignments, few per pair, and windows of items are cut out of the packed streams, so
that items are shuffled once to be keyed and never again one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.functions.bits import items_match, seed_key
from refrain.operators.blocks import meet
from refrain.operators.intervals import merge, runs
from refrain.plans.params import DetectParams
from refrain.sources.shared import materialize

SCOPE = ("folder", "bits")
#: Items of one key that a task takes of the side whose buckets have no cap.
HOT = 1 << 17


def exploded(streams: DataFrame, name: str, scope: Sequence[str] = SCOPE, extra: Sequence[str] = ()) -> DataFrame:
    """(scope, name, extra, pos, key) of each item."""
    items = streams.select(*scope, F.col("file").alias(name), *extra, F.posexplode("items").alias("pos", "v"))
    return items.withColumn("key", seed_key(F.col("v"), F.col("bits"))).drop("v")


def seed_index(streams: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """(scope, file, key, n): bucket sizes of each stream's seed keys."""
    return exploded(streams, "file", scope).groupBy(*scope, "file", "key").agg(F.count(F.lit(1)).alias("n"))


def votes(a: DataFrame, b: DataFrame, params: DetectParams, scope: Sequence[str] = SCOPE, extra: Sequence[str] = (), where: Callable | None = None) -> DataFrame:
    """(scope, a, b, off, votes, lo, hi): item pairs with equal keys, by alignment; lo and hi are a's outermost positions.

    b's buckets of over ``seed_max_bucket`` items don't vote. ``where`` tells which streams meet: a
    condition built from two functions, which give a's and b's columns of those named in
    ``extra``. Both sides are placed by scope and key once: the bucket sizes are counted where the
    join finds them. A key with over ``HOT`` of a's items has several places: a's items are dealt
    to them, and each has a copy of b's.
    """
    place = [*scope, "key"]

    def side(streams: DataFrame, name: str) -> DataFrame:
        return exploded(streams, name, scope, extra).withColumnsRenamed({c: f"{name}_{c}" for c in ("pos", *extra)})

    left, right = side(a, "a"), side(b, "b")
    parts = F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("_parts")
    hot = materialize(exploded(a, "a", scope).groupBy(*place).agg(parts).filter("_parts > 1"), "hot-keys")
    if not hot.isEmpty():
        # how many keys are hot is known by now, so the table's size decides how it is joined
        left = left.join(hot, place, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("a", "a_pos"), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
        right = right.join(hot, place, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        place.append("_part")
    right = right.repartition(*place).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*place, "b"))).filter(F.col("_n") <= params.seed_max_bucket).drop("_n")
    met = left.repartition(*place).join(right, place)
    if where is not None:
        met = met.filter(where(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")))
    return met.groupBy(*scope, "a", "b", (F.col("b_pos") - F.col("a_pos")).alias("off")).agg(F.count(F.lit(1)).alias("votes"), F.min("a_pos").alias("lo"), F.max("a_pos").alias("hi"))


def candidate_offsets(voted: DataFrame, params: DetectParams, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Of each pair (a, b) the alignments worth verifying: well voted, votes close together, the best few.

    ``turn`` is the order in which equally good alignments are preferred.
    """
    strong = voted.filter((F.col("votes") >= params.seed_min_votes) & (F.col("hi") - F.col("lo") <= F.col("votes") * params.seed_max_spread))
    pair = Window.partitionBy(*scope, "a", "b")
    best = strong.withColumn("_rank", F.row_number().over(pair.orderBy(F.desc("votes"), F.desc("off")))).withColumn("_n", F.count(F.lit(1)).over(pair))
    kept = best.filter(F.col("_rank") <= params.top_offsets)
    first = F.row_number().over(pair.orderBy("lo", "off"))
    return kept.withColumn("turn", F.when(F.col("_n") > params.top_offsets, F.col("_rank")).otherwise(first)).drop("_rank", "_n")


def aligned(cands: DataFrame, a: DataFrame, b: DataFrame, scope: Sequence[str] = SCOPE, margin: int | None = None, a_extra: Sequence[str] = ()) -> DataFrame:
    """``cands`` with na, nb, from, and the items of both sides where they overlap: xs of a from ``from`` on, ys of b.

    With a ``margin`` only the votes' surroundings are cut out, else all of a.
    """
    on = [*scope, "a"]
    left = a.select(*scope, F.col("file").alias("a"), F.col("items").alias("_items"), *a_extra)
    right = b.select(*scope, F.col("file").alias("b"), F.col("items").alias("_items"))
    off = F.col("off")
    found = cands.join(left, on).withColumn("na", F.size("_items"))
    begin = F.greatest(F.lit(0), -off) if margin is None else F.greatest(F.lit(0), -off, F.col("lo") - margin)
    end = F.col("na") if margin is None else F.least(F.col("na"), F.col("hi") + 1 + margin)
    found = found.withColumns({"from": begin, "_to": end}).withColumn("xs", F.slice("_items", F.col("from") + 1, F.greatest(F.col("_to") - F.col("from"), F.lit(0)))).drop("_items", "_to")
    found = found.join(right, [*scope, "b"]).withColumn("nb", F.size("_items"))
    # where b ends first, a's items have no partner
    length = F.least(F.size("xs"), F.greatest(F.col("nb") - off - F.col("from"), F.lit(0)))
    found = found.withColumn("xs", F.slice("xs", F.lit(1), length)).withColumn("ys", F.slice("_items", F.col("from") + off + 1, F.size("xs")))
    return found.drop("_items")


def covered_positions(params: DetectParams) -> Column:
    """Of an aligned row, a's positions whose items match."""
    err = params.bit_err(F.col("bits"))
    hits = F.zip_with("xs", "ys", lambda x, y: items_match(x, y, err))
    positions = F.transform(hits, lambda hit, i: F.when(hit, i + F.col("from")))
    return F.filter(positions, lambda p: p.isNotNull())


def coverage_at(cands: DataFrame, a: DataFrame, b: DataFrame, params: DetectParams, scope: Sequence[str] = SCOPE) -> DataFrame:
    """(cands, na, nb, positions): a's matching positions over its whole length at each alignment."""
    return aligned(cands, a, b, scope).withColumn("positions", covered_positions(params)).drop("xs", "ys", "from")


def match_cover(covers: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """(scope, a, b, pos): a's positions that match at any alignment."""
    return covers.select(*scope, "a", "b", F.explode("positions").alias("pos")).distinct()


def pair_runs(streams: DataFrame, params: DetectParams, scope: Sequence[str] = SCOPE) -> DataFrame:
    """(scope, a, b, off, start, end): verified runs of each pair of streams, in a's positions.

    The stream with the smaller ``idx`` is a, and gives the least length and the largest gap.
    Votes are counted and alignments verified block by block, where the streams' items are.
    """
    return meet(streams, None, params, scope, result="runs")


def recurrence_counts(found: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """(scope, file, pos, n): with how many other streams each position lies in a run, from ``pair_runs``.

    Runs of a pair are merged first, so a position counts once per pair. They are placed by
    their file once; merging and counting are done there.
    """
    a = found.select(*scope, F.col("a").alias("file"), F.col("b").alias("peer"), "start", "end")
    b = found.select(*scope, F.col("b").alias("file"), F.col("a").alias("peer"), (F.col("start") + F.col("off")).alias("start"), (F.col("end") + F.col("off")).alias("end"))
    merged = merge(a.union(b).repartition(*scope, "file"), [*scope, "file", "peer"])
    return merged.select(*scope, "file", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).groupBy(*scope, "file", "pos").agg(F.count(F.lit(1)).alias("n"))


def shows(streams: DataFrame, params: DetectParams, scope: Sequence[str] = SCOPE, extra: Sequence[str] = ()) -> DataFrame:
    """(scope, file, extra, pos, n): ``recurrence_counts`` of the streams' ``pair_runs``, whose number grows with the square of a group of streams.

    They are counted where they are found; only each stream's steps in its counts are shuffled.
    Steps and sizes are stored: what is returned doesn't read the streams again.
    """
    place = [*scope, "file"]
    steps = meet(streams, None, params, scope, result="shows").repartition(*place)
    steps = steps.select(*place, F.explode(F.arrays_zip("at", "step")).alias("_s")).groupBy(*place, F.col("_s.at").alias("pos")).agg(F.sum("_s.step").alias("step"))
    w = Window.partitionBy(*place).orderBy("pos")
    sizes = materialize(streams.select(*place, *extra, F.size("items").alias("_size")), "sizes")
    counts = steps.withColumns({"n": F.sum("step").over(w), "_next": F.lead("pos").over(w)}).join(sizes, place)
    return counts.filter("n > 0").select(*place, *extra, F.explode(F.sequence("pos", F.coalesce("_next", "_size") - 1)).alias("pos"), "n")


def recurring_segments(streams: DataFrame, params: DetectParams, scope: Sequence[str] = SCOPE) -> DataFrame:
    """(scope, file, start, end, start_sec, end_sec, n): stretches present in at least ``min_shows`` streams."""
    timed = shows(streams, params, scope, ("item_sec",)).filter(F.col("n") >= params.min_shows - 1).drop("n")
    sec = F.col("item_sec")
    by = [*scope, "file", "item_sec"]
    return runs(timed, by, params.min_items(sec), params.max_gap_items(sec), params.min_density).select(
        *scope, "file", "start", "end", (F.col("start") * sec).alias("start_sec"), (F.col("end") * sec).alias("end_sec"), "n"
    )


def alignments(patterns: DataFrame, streams: DataFrame, params: DetectParams, scope: Sequence[str] = SCOPE, extra: Sequence[str] = (), where: Callable | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(scope, a, b, off, turn, n, na, ratio, start, end): patterns (a) at each candidate alignment with streams (b) that ``where`` lets meet.

    With ``pairs`` (a, b) only those are looked at.
    """
    voted = meet(patterns, streams, params, scope, extra)
    if where is not None:
        voted = voted.filter(where(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).drop(*(f"{s}_{c}" for s in "ab" for c in extra))
    if pairs is not None:
        voted = voted.join(pairs, ["a", "b"], "left_semi")
    # the blocks' shuffles are gone before the streams are shuffled once more
    cands = materialize(candidate_offsets(voted, params, scope), "candidates")
    covers = coverage_at(cands, patterns, streams, params, scope)
    p = F.col("positions")
    hit = covers.withColumn("n", F.size(p)).filter("n > 0")
    return hit.select(
        *scope, "a", "b", "off", "turn", "n", "na", (F.col("n") / F.col("na")).alias("ratio"),
        F.greatest(F.lit(0), F.element_at(p, 1) + F.col("off")).alias("start"), F.least(F.col("nb"), F.element_at(p, -1) + F.col("off") + 1).alias("end"),
    )


def best_ratio(found: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """(scope, a, b, ratio): the largest share of a that matches b at one alignment. Not symmetric."""
    return found.groupBy(*scope, "a", "b").agg(F.max("ratio").alias("ratio"))


def locate(found: DataFrame, params: DetectParams, scope: Sequence[str] = SCOPE) -> DataFrame:
    """(scope, a, b, start, end, n): where a pattern fits a stream best, if it fits well enough."""
    pair = Window.partitionBy(*scope, "a", "b").orderBy(F.desc("n"), "turn")
    best = found.withColumn("_rank", F.row_number().over(pair)).filter("_rank = 1")
    return best.filter(F.col("ratio") >= params.locate_min_ratio).select(*scope, "a", "b", "start", "end", "n")


def locate_all(found: DataFrame, params: DetectParams, scope: Sequence[str] = SCOPE) -> DataFrame:
    """(scope, a, b, start, end): every place a pattern fits well enough, strongest first, none overlapping another.

    A pair has at most ``top_offsets`` alignments, so its places are folded as one short array.
    """
    fits = found.filter((F.col("ratio") >= params.locate_min_ratio) & (F.col("end") > F.col("start")))
    spans = fits.groupBy(*scope, "a", "b").agg(F.sort_array(F.collect_list(F.struct("n", "start", "end")), asc=False).alias("_spans"))
    empty = F.array().cast("array<struct<n:int,start:int,end:int>>")
    free = lambda taken, s: ~F.exists(taken, lambda t: (s["end"] > t["start"]) & (s["start"] < t["end"]))
    chosen = F.aggregate("_spans", empty, lambda taken, s: F.when(free(taken, s), F.concat(taken, F.array(s))).otherwise(taken))
    return spans.withColumn("_t", F.explode(chosen)).select(*scope, "a", "b", F.col("_t.start").alias("start"), F.col("_t.end").alias("end"))
