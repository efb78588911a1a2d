"""The library's queries over the driver's tables; the SQL that checks them is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions import bits, media
from refrain.operators import catalog, intervals, match, reconcile
from refrain.plans import progress as progress_plan
from refrain.plans import removal
from refrain.plans.inputs import TEXT_PARAMS, benchmark_patterns, document_streams, event_patterns, event_ranges, table
from refrain.plans.oracles import ORACLES
from refrain.plans.params import DetectParams
from refrain.sources.library import folders
from refrain.sources.shared import discard, materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Segments of a class of lengths that are paired in one place.
PAIRED = 1 << 12
#: Patterns and documents meet by width alone.
WIDTH = ("bits",)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _md5_item(column: str, digits: int) -> Column:
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, digits), 16, -10).cast("long")


@query
def classify_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.array(*map(F.lit, ("mp3", "MKV", "txt", "m4b", "webm", "tar.gz", "ts")))
    path = F.concat("source", F.lit("/ep "), "doc_id", F.lit("."), F.get(endings, (F.col("doc_id") % 7).cast("int")))
    return table(spark, sf_dir, "documents").select(path.alias("path")).withColumn("kind", media.classify_ext(F.col("path")))


@query
def items_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _md5_item("o_orderkey", 8), _md5_item("o_custkey", 8)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), bits.differing_bits(a, b).alias("bits"), bits.items_match(a, b, 8).alias("matches"), bits.items_match(a, b, TEXT_PARAMS.scaled(64).max_bit_err).alias("loosely"))


@query
def key_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), bits.seed_key(_md5_item("o_orderkey", 8), 32).alias("key32"), bits.seed_key(_md5_item("o_orderkey", 16), 64).alias("key64"))


@query
def dhash_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", bits.dhash(F.col("embedding")).alias("hash"))


@query
def seed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.seed_index(document_streams(spark, sf_dir)).drop("bits")


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    patterns, streams = benchmark_patterns(spark, sf_dir), document_streams(spark, sf_dir)
    return match.candidate_offsets(match.votes(patterns, streams, TEXT_PARAMS, WIDTH), TEXT_PARAMS, WIDTH), patterns, streams


@query
def candidate_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)[0].select("a", "b", "off", "votes", "lo", "hi", "turn")


@query
def coverage_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    covers = match.coverage_at(*_candidates(spark, sf_dir), TEXT_PARAMS, WIDTH).filter(F.size("positions") > 0)
    return covers.select("a", "b", "off", F.size("positions").alias("n"), F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last"))


@query
def match_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_cover(match.coverage_at(*_candidates(spark, sf_dir), TEXT_PARAMS, WIDTH), WIDTH).drop("bits")


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.alignments(benchmark_patterns(spark, sf_dir), document_streams(spark, sf_dir), TEXT_PARAMS, WIDTH)


@query
def best_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.best_ratio(_alignments(spark, sf_dir), WIDTH).select("a", "b", F.round("ratio", 6).alias("ratio"))


@query
def locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.locate(_alignments(spark, sf_dir), TEXT_PARAMS, WIDTH).drop("bits")


@query
def locate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.locate_all(_alignments(spark, sf_dir), TEXT_PARAMS, WIDTH).drop("bits")


@query
def pair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.pair_runs(document_streams(spark, sf_dir), TEXT_PARAMS).drop("bits")


@query
def recurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_streams(spark, sf_dir)
    counts = match.shows(docs, TEXT_PARAMS).drop("bits")
    discard(docs)  # steps and sizes are stored
    return counts


@query
def recurring_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.recurring_segments(document_streams(spark, sf_dir), TEXT_PARAMS).drop("bits")


@query
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = event_ranges(spark, sf_dir).select("file", F.floor(F.col("start") / 3600).alias("pos")).distinct()
    return intervals.runs(hours, ["file"], 4, 3, 0.5)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 3).alias(c) if c in ("start", "end", "saved") else c for c in df.columns))


@query
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(intervals.merge(event_ranges(spark, sf_dir).filter(F.col("end") > F.col("start")), ["file"]))


@query
def saved_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(intervals.saved_seconds(event_ranges(spark, sf_dir), ["file"]))


@query
def complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = event_ranges(spark, sf_dir)
    whole = ranges.select("file").distinct().withColumn("duration", F.lit(2_000_000.0))
    return _rounded(intervals.complement(ranges, whole, ["file"]))


@query
def slice_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin = F.col("file") % 10
    part = bits.slice_seconds(F.col("items"), F.lit(0.5), begin + 0.5, begin + 7.25)
    return document_streams(spark, sf_dir).select("file", F.aggregate(part, F.expr("0L"), lambda t, x: t + x).alias("total"), F.size(part).cast("long").alias("n"))


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(document streams, their recurring segments as streams of their own)."""
    docs = document_streams(spark, sf_dir)
    # narrow rows, found before the documents are shuffled
    found = materialize(match.recurring_segments(docs, TEXT_PARAMS), "found").join(docs.select("folder", "bits", "file", "items", "item_sec"), ["folder", "bits", "file"])
    cut = bits.slice_seconds(F.col("items"), F.col("item_sec"), F.col("start_sec"), F.col("end_sec"))
    # a segment's number: its document's, and where in it
    name = F.col("file") * 1_000_000 + F.col("start")
    return docs, materialize(found.select("folder", "bits", name.alias("file"), name.alias("idx"), F.col("file").alias("doc"), "start", "start_sec", "end_sec", "item_sec", cut.alias("items"), (F.col("end_sec") - F.col("start_sec")).alias("duration")), "segments")


@query
def length_compatible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # of segments only the lengths are needed: no items are cut out or shuffled, and the streams go before the pairs are written
    docs = document_streams(spark, sf_dir)
    found = materialize(match.recurring_segments(docs, TEXT_PARAMS), "found")
    discard(docs)
    segs = found.select("folder", F.col("file").alias("doc"), "start", (F.col("file") * 1_000_000 + F.col("start")).alias("idx"), (F.col("end_sec") - F.col("start_sec")).alias("duration"))
    a, b = (segs.withColumnsRenamed({c: f"{c}_{x}" for c in ("doc", "start", "idx", "duration")}) for x in "ab")
    # compatible lengths differ by a quarter of the shorter at most: by one class of lengths
    size = lambda c: F.floor(F.log(c) / F.log(F.lit(1 / (1 - reconcile.LENGTH_TOL)))).cast("int")
    a = a.withColumn("_class", size("duration_a"))
    b = b.withColumn("_class", F.explode(F.array(*(size("duration_b") + k for k in (-1, 0, 1)))))
    # most segments are short: a class's a's are dealt to several places, and each has a copy of the b's
    place = ["folder", "_class"]
    parts = materialize(a.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / PAIRED).cast("int").alias("_parts")), "classes")
    a = a.join(parts, place).withColumn("_part", F.pmod(F.xxhash64("idx_a"), F.col("_parts")).cast("int")).drop("_parts")
    b = b.join(parts, place).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    pairs = a.join(b, [*place, "_part"]).filter((F.col("idx_a") < F.col("idx_b")) & reconcile.length_compatible(F.col("duration_b"), F.col("duration_a")))
    return pairs.select("folder", F.col("doc_a").alias("file_a"), "start_a", F.col("doc_b").alias("file_b"), "start_b")


@query
def leader_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = _segments(spark, sf_dir)[1]
    return reconcile.leader_edges(segs, segs, TEXT_PARAMS, self_match=True).select("folder", "a", "b", F.round("ratio", 6).alias("ratio"))


@query
def leader_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = _segments(spark, sf_dir)[1]
    none = segs.select("folder", F.col("file").alias("segment"), F.col("file").alias("pattern")).limit(0)
    return reconcile.led(segs, none, TEXT_PARAMS)


@query
def known_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = match.locate_all(_alignments(spark, sf_dir), TEXT_PARAMS, WIDTH)
    found = places.select(F.col("a").alias("pattern_id"), F.col("b").alias("file_path"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    found = materialize(found.filter(F.col("end") - F.col("start") >= reconcile.SHORTEST), "known")
    stored = found.filter((F.col("pattern_id") + F.col("file_path")) % 2 == 0).select("pattern_id", "file_path", (F.col("start") + 0.5).alias("start"))
    return catalog.unknown_clips(found, stored)


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ranges(spark, sf_dir).select("id", "pattern_id", F.col("file").alias("file_path"), (F.col("start") / 3600).alias("start"), (F.col("end") / 3600).alias("end"))


@query
def clip_exists_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = _hours(spark, sf_dir).withColumn("pattern_id", F.col("pattern_id") % 5)
    new = clips.filter(F.col("id") % 2 == 1)
    return catalog.unknown_clips(new, clips.filter(F.col("id") % 2 == 0)).select("id", "pattern_id", "file_path")


def _event_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ranges(spark, sf_dir).withColumnRenamed("file", "file_path")


@query
def absorb_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = event_patterns(spark, sf_dir)
    confirmed = patterns.filter(F.col("status") == "confirmed").select("id")
    return reconcile.absorbed(patterns, _event_clips(spark, sf_dir), confirmed, 0.01)


@query
def dedupe_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.contained_clips(event_patterns(spark, sf_dir), _event_clips(spark, sf_dir), 60.0)


@query
def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each user that events of an hour's reach cover."""
    e = event_ranges(spark, sf_dir)
    day = F.floor(F.col("start") / 86400)
    parts = e.select("file", day.alias("day"), F.col("start").alias("part_start"), (F.col("start") + 7200.0).alias("part_end"))
    spans = e.select("file", day.alias("day")).distinct().select("file", "day", (F.col("day") * 86400.0 + 28800.0).alias("start"), (F.col("day") * 86400.0 + 43200.0).alias("end"))
    return intervals.covered(spans, parts, ["file", "day"], 7200.0)


def _catalog(spark: SparkSession, sf_dir: str) -> catalog.Catalog:
    """The events' patterns and clips as a catalogue."""
    empty = catalog.Catalog.empty(spark)
    clips = _event_clips(spark, sf_dir).withColumns({"orig_start": F.col("start") - F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.0)), "orig_end": F.col("end"), "preview": F.when(F.col("id") % 2 == 0, F.lit("p"))})
    patterns = event_patterns(spark, sf_dir).withColumns({"duration": F.col("id") * 61.5, "bits": F.lit(32)})
    return catalog.Catalog(catalog.migrated(patterns, "patterns"), catalog.migrated(clips.withColumn("file_name", F.concat(F.lit("u"), F.col("file_path").cast("string"))), "clips"), empty.processed, empty.fingerprints)


@query
def recount_shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _catalog(spark, sf_dir)
    some = catalog.delete_clips(found, found.clips.filter(F.col("pattern_id") % 10 == 3).select("id"))
    return catalog.recount_shows(some).patterns.select("id", "status", "shows")


@query
def patterns_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.payload(_catalog(spark, sf_dir).patterns, _catalog(spark, sf_dir).clips)
    clip = found.select("id", "status", F.round("duration", 1).alias("duration"), F.posexplode("clips").alias("at", "clip"))
    return clip.select("id", "status", "duration", "at", F.col("clip.id").alias("clip_id"), F.col("clip.edited").alias("edited"), F.col("clip.has_preview").alias("has_preview"))


@query
def export_markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.recount_shows(_catalog(spark, sf_dir))
    saved = intervals.saved_seconds(event_ranges(spark, sf_dir), ["file"])
    processed = saved.select(F.col("file").alias("id"), F.concat(F.lit("u"), F.col("file").cast("string")).alias("file_name"), F.array(F.struct(F.lit(0.0).alias("start"), F.col("saved").alias("end"))).alias("removed"), F.col("saved").alias("saved_sec"))
    return catalog.export_markdown(found.patterns, found.clips, processed)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("file_path") % 5 == 0, "video").otherwise("audio")
    users = event_ranges(spark, sf_dir).select(F.col("file").alias("file_path")).distinct()
    return users.select(F.concat(F.lit("u"), F.col("file_path").cast("string"), F.lit("."), F.get(F.array(*map(F.lit, ("mp3", "flac", "wma", "opus"))), (F.col("file_path") % 4).cast("int"))).alias("name"), "file_path", kinds.alias("kind"), F.when(F.col("file_path") % 7 == 0, 0.0).otherwise(2_000_000.0).alias("duration"))


@query
def remove_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    clips = _event_clips(spark, sf_dir).join(files.select("file_path", "name"), "file_path").drop("file_path").withColumnRenamed("name", "file_path")
    plan = removal.remove_plan(removal.confirmed_ranges(event_patterns(spark, sf_dir), clips), files.drop("file_path").withColumnRenamed("name", "file_path"))
    kept = F.aggregate("keep", F.lit(0.0), lambda t, k: t + k["end"] - k["start"])
    return plan.select("file_path", F.size("removed").alias("n_removed"), F.size("keep").alias("n_keep"), F.round(kept, 2).alias("kept_sec"), F.round("saved_sec", 2).alias("saved_sec"), "encoder", "out_ext", F.col("error").isNotNull().alias("failed"))


@query
def processed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select(F.col("name").alias("file_name"), "kind")
    return removal.trimmed_flags(files, files.filter(F.col("kind") == "video").select("file_name"))


@query
def folder_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders(_files(spark, sf_dir).select(F.concat(F.lit("f"), (F.col("file_path") % 9).cast("string")).alias("folder"), "kind"))


@query
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.array(*map(F.lit, ("fingerprint", "detect", "detect_progress", "matched", "normalize", "preview", "done")))
    e = table(spark, sf_dir, "events").select("event_id", F.get(stages, (F.col("event_id") % 7).cast("int")).alias("stage"), F.col("event_type").alias("file"), (F.col("event_id") % 100).alias("index"), F.lit(128).alias("total"), (F.col("user_id") * 0.5).alias("elapsed"), (F.col("event_id") % 20).alias("previews"))
    return progress_plan.enriched(e).select("event_id", "stage", F.coalesce("percent", F.lit(-1.0)).alias("percent"), F.coalesce("eta_seconds", F.lit(-1)).alias("eta_seconds"))


def _scanned(spark: SparkSession, sf_dir: str) -> tuple[catalog.Catalog, DetectParams]:
    """A catalogue of the documents' recurring segments, before lengths are normalised."""
    docs, segs = _segments(spark, sf_dir)
    prints = docs.select(F.col("file").cast("string").alias("file_path"), "folder", "bits", "item_sec", "items")
    found = catalog.store_fingerprints(catalog.Catalog.empty(spark), prints, 0.0)
    batch = segs.select("folder", "bits", F.col("doc").cast("string").alias("file"), "start_sec", "end_sec", F.col("doc").alias("idx"))
    found = reconcile.store_segments(found, batch, TEXT_PARAMS, "lib", 0.0).settled()
    discard(docs)  # the catalogue has its own copy
    return found, TEXT_PARAMS


@query
def store_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir)[0].patterns.select("id", "folder", "status", "duration", "shows")


@query
def normalize_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, params = _scanned(spark, sf_dir)
    return reconcile.normalize_lengths(found, found.patterns.select("id"), params, 1.0).clips.select("id", "pattern_id", "file_path", "start", "end")


@query
def relocate_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, params = _scanned(spark, sf_dir)
    clip = found.clips.agg(F.min("id")).first()[0]
    return (found if clip is None else reconcile.relocate_group(found, clip, params, 1.0)).clips.select("id", "pattern_id", "file_path", "start", "end")


__all__ = ["ORACLES", "QUERIES"]
