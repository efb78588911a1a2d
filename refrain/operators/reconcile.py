"""Reconciliation: detections become patterns, and nested or repeated ones are resolved.

Similarity, overlap and coverage are joins; leaders are found in rounds of joins, batch by
batch, so that segments are compared with the leaders before them and not with each other. Only
one-to-one claims run per file in Python, over one pattern's clips and never over items.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.functions.bits import slice_seconds, trimmed
from refrain.operators import catalog as cat
from refrain.operators import intervals, match
from refrain.operators.catalog import Catalog
from refrain.plans.params import DetectParams
from refrain.sources.shared import materialize

#: How far lengths of one pattern differ, and the shortest clip.
LENGTH_TOL = 0.20
SHORTEST = 0.2
#: Segments of a folder in the first batch that leaders are looked for in, and how much more all batches so far hold with the next.
FIRST = 2048
GROWTH = 8


def pattern_streams(patterns: DataFrame) -> DataFrame:
    items = trimmed(F.col("items"), F.col("head_items"), F.col("tail_items"))
    return patterns.select("folder", F.col("id").alias("file"), F.col("id").alias("idx"), "bits", "item_sec", items.alias("items"), "duration")


def file_streams(fingerprints: DataFrame) -> DataFrame:
    return fingerprints.select("folder", F.col("file_path").alias("file"), "bits", "item_sec", "items")


def length_compatible(a: Column, b: Column) -> Column:
    longer = F.greatest(a, b)
    return (longer <= 0) | (F.abs(a - b) / longer <= LENGTH_TOL)


def known_occurrences(patterns: DataFrame, fingerprints: DataFrame, params: DetectParams) -> DataFrame:
    """(pattern_id, file_path, start, end): every place of the patterns in their folders' files, in seconds."""
    streams = file_streams(fingerprints)
    found = match.locate_all(match.alignments(pattern_streams(patterns), streams, params), params)
    sec = streams.select("folder", "bits", F.col("file").alias("b"), "item_sec")
    timed = found.join(sec, ["folder", "bits", "b"]).select(F.col("a").alias("pattern_id"), F.col("b").alias("file_path"), (F.col("start") * F.col("item_sec")).alias("start"), (F.col("end") * F.col("item_sec")).alias("end"))
    return timed.filter(F.col("end") - F.col("start") >= SHORTEST)


def apply_known(catalog: Catalog, params: DetectParams, now: float, ids: DataFrame | None = None, files: DataFrame | None = None) -> tuple[Catalog, DataFrame]:
    """Adds a clip wherever a confirmed pattern is and no clip yet, nor one just added; the added ones.

    With ``ids`` those patterns whatever their length and state, else all confirmed ones of at least the
    least length; with ``files`` (file_path) only there.
    """
    chosen = catalog.patterns.join(ids.select("id"), "id", "left_semi") if ids is not None else catalog.patterns.filter((F.col("status") == "confirmed") & (F.col("duration") >= params.min_seconds))
    prints = catalog.fingerprints if files is None else catalog.fingerprints.join(files.select("file_path"), "file_path", "left_semi")
    added = materialize(cat.new_clips(known_occurrences(chosen, prints, params), catalog.clips), "known")
    bumps = added.groupBy(F.col("pattern_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    bumped = catalog.patterns.join(bumps, "id", "left").withColumns({"shows": F.col("shows") + F.coalesce("_n", F.lit(0)), "updated_at": F.when(F.col("_n").isNotNull(), now).otherwise(F.col("updated_at"))})
    return cat.add_clips(replace(catalog, patterns=bumped.select(*catalog.patterns.columns)), added, now), added


def leader_edges(segments: DataFrame, leaders: DataFrame, params: DetectParams, self_match: bool = False) -> DataFrame:
    """(folder, bits, a, b, ratio): segments (a) that fit a leader (b) of compatible length well enough.

    Both sides are streams with a duration. With ``self_match`` leaders are segments too, earlier
    by idx. Length and order are told before any alignment is counted.
    """

    def may_lead(a, b) -> Column:  # noqa: ANN001
        fits = length_compatible(a("duration"), b("duration"))
        return fits & (b("idx") < a("idx")) if self_match else fits

    found = match.alignments(segments, leaders, params, extra=("duration", "idx") if self_match else ("duration",), where=may_lead)
    return match.best_ratio(found).filter(F.col("ratio") >= params.dedupe_ratio).select("folder", "bits", "a", "b", "ratio")


def assign_leaders(segments: DataFrame, known: DataFrame, among: DataFrame) -> DataFrame:
    """(folder, segment, leader, known): each segment's pattern, in the order of idx.

    segments: folder, segment, idx. known: folder, segment, pattern (the oldest pattern that it
    fits). among: folder, segment, earlier (segments that it fits). A segment takes the first
    that fits: known patterns by id, then earlier segments that lead; else it leads itself.

    In each round those lead that have no undecided earlier segment left, and whoever fits one of
    them follows; so a round decides all segments whose order is settled, in any number of tasks.
    """
    key = ["folder", "segment"]
    taken = known.groupBy(*key).agg(F.min("pattern").alias("leader"))
    todo = materialize(segments.select(*key, "idx").join(taken.select(*key), key, "left_anti"), "undecided")
    earlier = todo.select("folder", F.col("segment").alias("earlier"), F.col("idx").alias("earlier_idx"))
    edges = fits = materialize(among.select(*key, "earlier").distinct().join(todo.select(*key), key, "left_semi").join(earlier, ["folder", "earlier"]), "fits")
    lead = []
    while todo.limit(1).count():
        new = materialize(todo.join(edges.select(*key).distinct(), key, "left_anti").select(*key), "leaders")
        lead.append(new)
        follow = edges.join(new.withColumnRenamed("segment", "earlier"), ["folder", "earlier"], "left_semi").select(*key).distinct()
        todo = materialize(todo.join(new, key, "left_anti").join(follow, key, "left_anti"), "undecided")
        left = todo.select("folder", F.col("segment").alias("earlier"))
        edges = materialize(edges.join(todo.select(*key), key, "left_semi").join(left, ["folder", "earlier"], "left_semi"), "fits")
    none = todo.select(*key)  # empty by now
    leading = none
    for new in lead:
        leading = leading.union(new)
    leading = materialize(leading, "leading")
    first = fits.join(leading.withColumnRenamed("segment", "earlier"), ["folder", "earlier"], "left_semi").groupBy(*key).agg(F.min(F.struct("earlier_idx", "earlier")).alias("f"))
    own = leading.select(*key, F.col("segment").alias("leader"))
    following = first.join(leading, key, "left_anti").select(*key, F.col("f.earlier").alias("leader"))
    return taken.join(segments.select(*key), key, "left_semi").select(*key, "leader", F.lit(True).alias("known")).union(own.union(following).withColumn("known", F.lit(False)))


def led(segments: DataFrame, known: DataFrame, params: DetectParams) -> DataFrame:
    """``assign_leaders`` of segments, which are stored streams with a duration, by their ``leader_edges``.

    Batches are taken in the order of idx. Leaders of earlier batches come first, so a batch meets
    those and only what fits none of them meets itself: the alignments that become rows don't
    grow with the square of a group of alike segments.
    """
    key = ["folder", "segment"]
    names = segments.select("folder", F.col("file").alias("segment"), "idx")
    taken = known.groupBy(*key).agg(F.min("pattern").alias("leader")).join(names.select(*key), key, "left_semi")
    place = F.row_number().over(Window.partitionBy("folder").orderBy("idx")) - 1
    batch = F.when(place < FIRST, 0).otherwise(F.floor(F.log(place / FIRST + 1e-9) / F.log(F.lit(GROWTH))).cast("int") + 1)
    begins = names.withColumn("_batch", batch).groupBy("folder", "_batch").agg(F.min("idx").alias("_from")).groupBy("folder").agg(F.sort_array(F.collect_list("_from")).alias("_from"))
    begins = materialize(begins, "batches")
    free = segments.join(taken.select("folder", F.col("segment").alias("file")), ["folder", "file"], "left_anti").join(begins, "folder")
    free = materialize(free.withColumn("_batch", F.size(F.filter("_from", lambda x: x <= F.col("idx"))) - 1).select("_batch", *segments.columns), "undecided")
    none = known.select(*key, "pattern").limit(0)
    found, leaders = [taken.select(*key, "leader", F.lit(True).alias("known"))], None
    for k in range(begins.agg(F.max(F.size("_from"))).first()[0] or 0):
        rest = free.filter(F.col("_batch") == k).select(*segments.columns)
        if leaders is not None:
            fits = leader_edges(rest, leaders, params).join(leaders.select("folder", F.col("file").alias("b"), F.col("idx").alias("_first")), ["folder", "b"])
            first = fits.groupBy("folder", F.col("a").alias("segment")).agg(F.min(F.struct("_first", "b")).alias("f"))
            follow = materialize(first.select(*key, F.col("f.b").alias("leader"), F.lit(False).alias("known")), "followers")
            found.append(follow)
            rest = materialize(rest.join(follow.select("folder", F.col("segment").alias("file")), ["folder", "file"], "left_anti").select(*segments.columns), "rest")
        among = leader_edges(rest, rest, params, self_match=True).select("folder", F.col("a").alias("segment"), F.col("b").alias("earlier"))
        assigned = materialize(assign_leaders(rest.select("folder", F.col("file").alias("segment"), "idx"), none, among), "assigned")
        found.append(assigned)
        new = assigned.filter(F.col("leader") == F.col("segment")).select("folder", F.col("segment").alias("file"))
        new = materialize(rest.join(new, ["folder", "file"], "left_semi").select(*segments.columns), "leaders")
        leaders = new if leaders is None else leaders.union(new)
    return reduce(DataFrame.union, found)


def store_segments(catalog: Catalog, found: DataFrame, params: DetectParams, library: str, now: float) -> Catalog:
    """found: folder, bits, file (path), start_sec, end_sec of this batch, in file order ``idx``. New patterns are pending.

    A segment that a pattern's clip already marks adds nothing.
    """
    prints = catalog.fingerprints.select("folder", "bits", F.col("file_path").alias("file"), "item_sec", "items")
    segs = found.join(prints, ["folder", "bits", "file"]).withColumn("items", slice_seconds(F.col("items"), F.col("item_sec"), F.col("start_sec"), F.col("end_sec"))).filter(F.size("items") > 0)
    order = Window.partitionBy("folder").orderBy("bits", "idx", "start_sec")
    segs = segs.withColumn("seq", F.row_number().over(order).cast("long"))
    segs = materialize(segs.select("folder", "bits", F.col("file").alias("path"), "start_sec", "end_sec", "item_sec", "items", (F.col("end_sec") - F.col("start_sec")).alias("duration"), F.col("seq").alias("idx"), F.col("seq").alias("file")), "segments")
    known = leader_edges(segs, pattern_streams(catalog.patterns), params)
    leaders = led(segs, known.select("folder", F.col("a").alias("segment"), F.col("b").alias("pattern")), params)
    placed = materialize(segs.join(leaders.withColumnRenamed("segment", "file"), ["folder", "file"]), "leaders")
    minted = placed.filter(~F.col("known") & (F.col("leader") == F.col("file")))
    order_by = ["folder", "idx"]
    numbered = materialize(cat.numbered(minted.select(F.lit(library).alias("library"), "folder", "items", "item_sec", "bits", "duration", F.col("file").alias("leader"), "idx"), catalog.patterns, order_by), "minted")
    made = cat.add_numbered_patterns(catalog, numbered.drop("leader", "idx"), now)
    names = numbered.select("folder", "leader", F.col("id").alias("_new"))
    clips = placed.join(names, ["folder", "leader"], "left").select(
        F.when(F.col("known"), F.col("leader")).otherwise(F.col("_new")).alias("pattern_id"), F.col("path").alias("file_path"), F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), "idx"
    )
    fresh = materialize(cat.new_clips(clips, catalog.clips), "fresh")
    return cat.recount_shows(cat.add_clips(made, fresh.drop("idx"), now), fresh.select(F.col("pattern_id").alias("id")), now)


def normalize_lengths(catalog: Catalog, ids: DataFrame, params: DetectParams, now: float) -> Catalog:
    """Snaps clips of unpinned patterns to where their median clip is found in each file, and re-derives the patterns.

    The median is the element at n // 2 by length, of equals by start; so it is for the found spans.
    """
    chosen = catalog.patterns.filter(~F.col("pinned")).join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("pattern_id"))
    prints = catalog.fingerprints.select("file_path", "folder", "bits", "item_sec", "items")
    # members are narrow; items are only joined to one clip of a pattern, and stored once of the files that have members
    member = catalog.clips.join(chosen, "pattern_id").join(prints.drop("items"), "file_path")
    by_length = Window.partitionBy("pattern_id").orderBy(F.col("end") - F.col("start"), "start", "id")
    ranked = member.withColumns({"_k": F.row_number().over(by_length) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("pattern_id"))}).filter("_n >= 2")
    ranked = materialize(ranked, "members")
    held = materialize(prints.join(ranked.select("file_path").distinct(), "file_path", "left_semi"), "members-files")
    cut = lambda df, start, end: df.join(held.select("file_path", "items"), "file_path").withColumn("items", slice_seconds(F.col("items"), F.col("item_sec"), F.col(start), F.col(end)))
    canon = cut(ranked.filter(F.col("_k") == F.floor(F.col("_n") / 2)), "start", "end").select("pattern_id", "folder", F.col("pattern_id").alias("file"), "bits", "item_sec", "items", (F.col("end") - F.col("start")).alias("_canon"))
    canon = materialize(canon.filter(F.size("items") > 0), "medians")
    # of the places in other patterns' files, as many as pairs of alike clips, none is wanted
    own = ranked.select(F.col("pattern_id").alias("a"), F.col("file_path").alias("b"))
    found = match.locate(match.alignments(canon, held.select("folder", "bits", F.col("file_path").alias("file"), "items"), params, pairs=own), params)
    hits = ranked.join(found.select(F.col("a").alias("pattern_id"), F.col("b").alias("file_path"), F.col("start").alias("_i"), F.col("end").alias("_j")), ["pattern_id", "file_path"]).join(canon.select("pattern_id", "_canon"), "pattern_id")
    hits = hits.withColumns({"_s": F.col("_i") * F.col("item_sec"), "_e": F.col("_j") * F.col("item_sec")})
    length = F.col("_e") - F.col("_s")
    hits = materialize(hits.filter((length > 0) & (F.abs(length - F.col("_canon")) <= 0.35 * F.col("_canon") + 1.0)), "relocated")
    again = Window.partitionBy("pattern_id").orderBy(length, "_k")
    medians = hits.withColumns({"_r": F.row_number().over(again) - 1, "_m": F.count(F.lit(1)).over(Window.partitionBy("pattern_id"))}).filter(F.col("_r") == F.floor(F.col("_m") / 2))
    tight = cut(medians, "_s", "_e").select(F.col("pattern_id").alias("id"), "items", length.alias("duration")).filter(F.size("items") > 0)
    snapped = cat.set_bounds(catalog, hits.select("id", F.col("_s").alias("start"), F.col("_e").alias("end")), detected=True)
    return cat.set_fingerprint(snapped, tight, now)


def absorbed(patterns: DataFrame, clips: DataFrame, confirmed: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(id): pending patterns that a confirmed one (id) of their folder covers.

    A clip is covered where one clip of the confirmed pattern overlaps that share of it; a
    pattern where that share of its clips is. Empty clips count among its clips only.
    """
    sure = patterns.join(confirmed.select("id"), "id", "left_semi").select(F.col("id").alias("by"), "folder")
    theirs = clips.join(sure.withColumnRenamed("by", "pattern_id"), "pattern_id").select(F.col("pattern_id").alias("by"), "folder", "file_path", F.col("start").alias("_s"), F.col("end").alias("_e"))
    pending = patterns.filter(F.col("status") == "pending").select(F.col("id").alias("pattern_id"), "folder")
    own = clips.join(pending, "pattern_id").select(F.col("id").alias("clip"), "pattern_id", "folder", "file_path", "start", "end")
    length = F.col("end") - F.col("start")
    overlap = F.greatest(F.lit(0.0), F.least("end", "_e") - F.greatest("start", "_s"))
    met = _stretched(own.filter(length > 0), F.col("start"), F.col("end")).drop("_first").join(_stretched(theirs, F.col("_s"), F.col("_e")).drop("_first"), ["folder", "file_path", "_stretch"])
    hit = met.filter((F.col("by") != F.col("pattern_id")) & (overlap / length >= threshold)).select("clip", "pattern_id", "by").distinct()
    covered = hit.groupBy("pattern_id", "by").agg(F.count(F.lit(1)).alias("_c"))
    total = own.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("_n"))
    return covered.join(total, "pattern_id").filter(F.col("_c") / F.col("_n") >= threshold).select(F.col("pattern_id").alias("id")).distinct()


#: Seconds of a file that meet in one task when ranges of it are compared.
STRETCH = 600.0


def _stretched(ranges: DataFrame, start: Column, end: Column) -> DataFrame:
    """``ranges`` once for each stretch of its file that it touches, with _stretch and _first, its first."""
    first, last = F.floor(start / STRETCH).cast("long"), F.floor(F.greatest(start, end) / STRETCH).cast("long")
    return ranges.withColumn("_first", first).withColumn("_stretch", F.explode(F.sequence(first, last)))


def contained_clips(patterns: DataFrame, clips: DataFrame, tol: float = 1.5) -> DataFrame:
    """(id): clips that strictly shorter clips of the same file and review state cover.

    What is dropped is never needed to cover what is longer, so this is one join. A clip no
    longer than ``tol`` without a later shorter one is covered by nothing at all, and dropped too.
    """
    c = clips.join(patterns.select(F.col("id").alias("pattern_id"), "status", "folder"), "pattern_id").select("id", "folder", "file_path", "status", "start", "end")
    length = F.col("end") - F.col("start")
    parts = c.select("folder", "file_path", "status", F.col("start").alias("part_start"), F.col("end").alias("part_end"))
    # a part that ends before the clip or starts after its end can't change the verdict
    reach = F.greatest("end", F.col("start") + tol) + tol
    place = ["folder", "file_path", "status", "_stretch"]
    met = _stretched(c, F.col("start"), reach).join(_stretched(parts, F.col("part_start"), F.col("part_end")).withColumnRenamed("_first", "_part_first"), place)
    near = met.filter(F.col("_stretch") == F.greatest("_first", "_part_first"))  # once a pair
    near = near.filter((F.col("part_end") - F.col("part_start") < length - 1e-6) & (F.col("part_end") > F.col("start")) & (F.col("part_start") <= reach))
    return intervals.covered(c.select("id", "start", "end"), _later(c, near, tol), ["id"], tol)


def _later(c: DataFrame, near: DataFrame, tol: float) -> DataFrame:
    """Parts near a clip; for clips no longer than ``tol``, of all later shorter ones the earliest too, as it ends the walk.

    Only clips that are short themselves can be shorter, and short clips are few.
    """
    key = ["folder", "file_path", "status"]
    length = F.col("end") - F.col("start")
    short = c.filter(length <= tol).select(*key, "id", "start", "end", length.alias("length"))
    after = short.alias("s").join(short.select(*key, F.col("start").alias("part_start"), F.col("end").alias("part_end"), F.col("length").alias("_l")), key)
    after = after.filter((F.col("_l") < F.col("length") - 1e-6) & (F.col("part_start") > F.col("start") + tol))
    first = after.groupBy("id").agg(F.min(F.struct("part_start", "part_end")).alias("p")).select("id", "p.part_start", "p.part_end")
    return near.select("id", "part_start", "part_end").union(first).distinct()


def dedupe_contained(catalog: Catalog, tol: float = 1.5, now: float = 0.0, folder: str | None = None) -> Catalog:
    patterns = catalog.patterns if folder is None else catalog.patterns.filter(F.col("folder") == folder)
    gone = materialize(contained_clips(patterns, catalog.clips, tol), "contained")
    touched = catalog.clips.join(gone, "id", "left_semi").select(F.col("pattern_id").alias("id"))
    return cat.recount_shows(cat.delete_clips(catalog, gone), materialize(touched.distinct(), "touched"), now)


def review(catalog: Catalog, pattern_id: int, verdict: str, params: DetectParams, now: float) -> Catalog:
    """'ad', 'not_ad' or 'pending'. A confirmed pattern is applied to all stored files, absorbs pending ones, and nested clips go."""
    status = {"ad": "confirmed", "not_ad": "dismissed", "pending": "pending"}.get(verdict)
    if status is None:
        raise ValueError(f"unknown verdict {verdict!r}")
    one = catalog.patterns.sparkSession.createDataFrame([(pattern_id,)], "id long")
    catalog = cat.set_status(catalog, one, status, now)
    if status != "confirmed":
        return catalog
    catalog, _ = apply_known(catalog, params, now, one)
    catalog = catalog.settled()
    catalog = cat.set_status(catalog, absorbed(catalog.patterns, catalog.clips, one), "dismissed", now)
    return dedupe_contained(catalog, now=now)


def claim_occurrences(clips: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(file_path, clip, start, end): clips and occurrences that overlap, one to one.

    A file's clips claim in order of start, each the first occurrence not yet claimed. Rows
    without a clip are unclaimed occurrences, rows without a start clips that found none.
    """
    both = clips.select("file_path", F.col("id").alias("clip"), "start", "end").unionByName(occurrences.select("file_path", F.lit(None).cast("long").alias("clip"), "start", "end"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        path = pdf.file_path.iloc[0]
        free = list(pdf[pdf["clip"].isna()].sort_values("start")[["start", "end"]].itertuples(index=False, name=None))
        out = []
        for c in pdf[pdf["clip"].notna()].sort_values(["start", "clip"]).itertuples():
            hit = next((o for o in free if min(c.end, o[1]) - max(c.start, o[0]) > 0), None)
            if hit:
                free.remove(hit)
            out.append((path, int(c.clip), *(hit or (None, None))))
        return pd.DataFrame(out + [(path, None, s, e) for s, e in free], columns=["file_path", "clip", "start", "end"]).astype({"clip": "Int64", "start": float, "end": float})

    return both.groupBy("file_path").applyInPandas(walk, "file_path string, clip long, start double, end double")


def relocate_group(catalog: Catalog, clip_id: int, params: DetectParams, now: float, split_nonmatches: bool = True) -> Catalog:
    """One cropped clip becomes its group's pattern: clips snap to where it is found, new places join, the rest may leave."""
    clip = catalog.clips.filter(F.col("id") == clip_id).join(catalog.fingerprints.select("file_path", "item_sec", "items"), "file_path")
    items = slice_seconds(F.col("items"), F.col("item_sec"), F.col("start"), F.col("end"))
    crop = materialize(clip.select(F.col("pattern_id").alias("id"), items.alias("items"), F.greatest("item_sec", F.col("end") - F.col("start")).alias("duration")), "crop")
    row = crop.select("id", "duration", F.size("items")).first()
    if row is None:
        raise LookupError("no stored fingerprint of the clip's file")
    pid, duration, n = row
    if not n:
        raise ValueError("the selection is too short to hold an item")
    catalog = cat.set_fingerprint(catalog, crop, now, pin=True).settled()
    pattern = catalog.patterns.filter(F.col("id") == pid)
    streams = file_streams(catalog.fingerprints)
    found = match.locate_all(match.alignments(pattern_streams(pattern), streams, params), params)
    places = found.join(streams.select("folder", "bits", F.col("file").alias("b"), "item_sec"), ["folder", "bits", "b"]).select(F.col("b").alias("file_path"), (F.col("start") * F.col("item_sec")).alias("start")).withColumn("end", F.col("start") + duration)
    claimed = materialize(claim_occurrences(catalog.clips.filter(F.col("pattern_id") == pid), places), "claimed")
    catalog = cat.set_bounds(catalog, claimed.filter("clip IS NOT NULL AND start IS NOT NULL").select(F.col("clip").alias("id"), "start", "end"), detected=True)
    new = claimed.filter("clip IS NULL").select(F.lit(pid).cast("long").alias("pattern_id"), "file_path", "start", "end")
    catalog = cat.add_clips(catalog, cat.new_clips(new, catalog.clips), now).settled()
    if split_nonmatches:
        lost = claimed.filter("clip IS NOT NULL AND start IS NULL").join(catalog.clips.select(F.col("id").alias("clip"), F.col("start").alias("at")), "clip").orderBy("at", "clip").select("clip")
        first = lost.first()
        if first is not None:
            catalog, leftover = cat.new_group(catalog, first[0], now)
            catalog = cat.move_clips(catalog, lost.select(F.col("clip").alias("id"), F.lit(leftover).cast("long").alias("pattern_id")), now)
    return cat.recount_shows(catalog, crop.select("id"), now)
