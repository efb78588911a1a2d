"""The catalogue: patterns, clips, processed files and stored fingerprints, as snapshots.

Tables are immutable: a mutation takes snapshots and returns new ones. Times are passed in,
so that a result depends on nothing but its inputs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.bits import slice_seconds
from refrain.functions.media import file_name
from refrain.sources.shared import is_stored, materialize

#: The review states, and how close two starts of one occurrence are.
STATUSES = ("pending", "confirmed", "dismissed")
SAME_START = 1.0

SCHEMAS = {
    "patterns": "id long, library string, folder string, status string, bits int, item_sec double, items array<long>, duration double, shows int, head_items int, tail_items int, orig_items array<long>, orig_duration double, pinned boolean, created_at double, updated_at double",
    "clips": "id long, pattern_id long, file_path string, file_name string, start double, end double, orig_start double, orig_end double, preview string, created_at double",
    "processed": "id long, file_path string, file_name string, output_path string, removed array<struct<start: double, end: double>>, saved_sec double, created_at double",
    "fingerprints": "file_path string, folder string, bits int, item_sec double, items array<long>, created_at double",
}


@dataclass(frozen=True)
class Catalog:
    patterns: DataFrame
    clips: DataFrame
    processed: DataFrame
    fingerprints: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Catalog:
        """Stored tables; columns that older ones lack get their defaults."""
        return cls(**{name: migrated(spark.read.parquet(f"{path}/{name}"), name) for name in SCHEMAS})

    def write(self, path: str) -> None:
        """To a path that none of the snapshots is read from; fingerprints by folder, as scans read them."""
        for name in SCHEMAS:
            w = getattr(self, name).write.mode("errorifexists")
            (w.partitionBy("folder") if name == "fingerprints" else w).parquet(f"{path}/{name}")

    def settled(self) -> Catalog:
        """The same without lineage, written to the shared folder; a table that is stored there already isn't written again."""
        tables = {name: getattr(self, name) for name in SCHEMAS}
        return Catalog(**{name: df if is_stored(df) else materialize(df, name) for name, df in tables.items()})


def migrated(df: DataFrame, name: str) -> DataFrame:
    """A table as its schema says: lacking columns added, original bounds and items filled in, old labels read as states."""
    spark = df.sparkSession
    defaults = {"shows": F.lit(1), "head_items": F.lit(0), "tail_items": F.lit(0), "pinned": F.lit(False), "saved_sec": F.lit(0.0)}
    has = set(df.columns)
    if name == "patterns":
        old = F.when(F.col("label") == "Ad", "confirmed") if "label" in has else F.lit(None)
        state = F.col("status") if "status" in has else F.lit(None)
        defaults["status"] = F.coalesce(old, state, F.lit("pending"))
        df = df.withColumn("status", defaults["status"])
    out = []
    for field in spark.createDataFrame([], SCHEMAS[name]).schema:
        c = F.col(field.name) if field.name in df.columns else defaults.get(field.name, F.lit(None))
        source = field.name.removeprefix("orig_")
        if source != field.name:
            c = F.coalesce(c, F.col(source))
        out.append(c.cast(field.dataType).alias(field.name))
    return df.select(*out)


def numbered(df: DataFrame, after: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ids that follow those of ``after``, in one order: rows are sorted by range, numbered within partitions, and partitions offset."""
    stored = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    next_id = (after.agg(F.max("id")).first()[0] or 0) + 1
    offsets = []
    for row in stored.groupBy(part.alias("part")).agg((F.max(place) + 1).alias("n")).orderBy("part").collect():  # one row a partition
        offsets.append((row["part"], next_id))
        next_id += row["n"]
    known = df.sparkSession.createDataFrame(offsets, "_part long, _first long")
    return stored.withColumn("_part", part).join(F.broadcast(known), "_part").withColumn("id", F.col("_first") + place).drop("_part", "_first", "_at")


def add_patterns(catalog: Catalog, new: DataFrame, now: float, order: list[str]) -> Catalog:
    """new: library, folder, items, item_sec, bits, duration and maybe status, shows."""
    return add_numbered_patterns(catalog, numbered(new, catalog.patterns, order), now)


def add_numbered_patterns(catalog: Catalog, new: DataFrame, now: float) -> Catalog:
    """new: as for ``add_patterns``, with id."""
    full = new.withColumns({"orig_items": F.col("items"), "orig_duration": F.col("duration"), "created_at": F.lit(now), "updated_at": F.lit(now)})
    return replace(catalog, patterns=catalog.patterns.unionByName(migrated(full, "patterns")))


def add_clips(catalog: Catalog, new: DataFrame, now: float, order: tuple[str, ...] = ("pattern_id", "file_path", "start")) -> Catalog:
    """new: pattern_id, file_path, start, end."""
    full = new.withColumns({"file_name": file_name(F.col("file_path")), "orig_start": F.col("start"), "orig_end": F.col("end"), "created_at": F.lit(now)})
    return replace(catalog, clips=catalog.clips.unionByName(migrated(numbered(full, catalog.clips, list(order)), "clips")))


def add_processed(catalog: Catalog, new: DataFrame, now: float) -> Catalog:
    """new: file_path, output_path, removed, saved_sec."""
    rounded = F.transform("removed", lambda r: F.struct(F.round(r["start"], 2).alias("start"), F.round(r["end"], 2).alias("end")))
    full = new.withColumns({"file_name": file_name(F.col("file_path")), "removed": rounded, "created_at": F.lit(now)})
    return replace(catalog, processed=catalog.processed.unionByName(migrated(numbered(full, catalog.processed, ["file_path"]), "processed")))


def store_fingerprints(catalog: Catalog, new: DataFrame, now: float) -> Catalog:
    """Upsert by path."""
    rest = catalog.fingerprints.join(new.select("file_path"), "file_path", "left_anti")
    return replace(catalog, fingerprints=rest.unionByName(migrated(new.withColumn("created_at", F.lit(now)), "fingerprints")))


def set_status(catalog: Catalog, ids: DataFrame, status: str, now: float) -> Catalog:
    """ids: column id."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    marked = catalog.patterns.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    changed = {"status": F.when(F.col("_hit"), status).otherwise(F.col("status")), "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))}
    return replace(catalog, patterns=marked.withColumns(changed).select(*catalog.patterns.columns))


def delete_patterns(catalog: Catalog, ids: DataFrame) -> Catalog:
    """With their clips."""
    gone = ids.select("id").distinct()
    return replace(catalog, patterns=catalog.patterns.join(gone, "id", "left_anti"), clips=catalog.clips.join(gone.withColumnRenamed("id", "pattern_id"), "pattern_id", "left_anti").select(*catalog.clips.columns))


def delete_clips(catalog: Catalog, ids: DataFrame) -> Catalog:
    return replace(catalog, clips=catalog.clips.join(ids.select("id"), "id", "left_anti"))


def recount_shows(catalog: Catalog, ids: DataFrame | None = None, now: float = 0.0) -> Catalog:
    """shows of (all or the given) patterns becomes their number of clips; patterns without any go."""
    counts = catalog.clips.groupBy(F.col("pattern_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    joined = catalog.patterns.join(counts, "id", "left")
    chosen = F.lit(True)
    if ids is not None:
        joined = joined.join(ids.select("id").distinct().withColumn("_chosen", F.lit(True)), "id", "left")
        chosen = F.coalesce("_chosen", F.lit(False))
    n = F.coalesce("_n", F.lit(0))
    kept = joined.filter(~chosen | (n > 0)).withColumns({"shows": F.when(chosen, n).otherwise(F.col("shows")), "updated_at": F.when(chosen & (n != F.col("shows")), now).otherwise(F.col("updated_at"))})
    return replace(catalog, patterns=kept.select(*catalog.patterns.columns))


def set_bounds(catalog: Catalog, new: DataFrame, detected: bool = False) -> Catalog:
    """new: id, start, end. A changed clip loses its preview; ``detected`` bounds are the original ones too."""
    joined = catalog.clips.join(new.select("id", F.col("start").alias("_s"), F.col("end").alias("_e")), "id", "left")
    hit = F.col("_s").isNotNull()
    changed = {"start": F.coalesce("_s", "start"), "end": F.coalesce("_e", "end"), "preview": F.when(~hit, F.col("preview"))}
    if detected:
        changed |= {"orig_start": F.coalesce("_s", "orig_start"), "orig_end": F.coalesce("_e", "orig_end")}
    return replace(catalog, clips=joined.withColumns(changed).select(*catalog.clips.columns))


def reset_clips(catalog: Catalog, ids: DataFrame) -> Catalog:
    """Back to the detected bounds."""
    back = catalog.clips.join(ids.select("id"), "id", "left_semi").select("id", F.coalesce("orig_start", "start").alias("start"), F.coalesce("orig_end", "end").alias("end"))
    return set_bounds(catalog, back)


def set_fingerprint(catalog: Catalog, new: DataFrame, now: float, pin: bool = False) -> Catalog:
    """new: id, items, duration. ``pin`` fixes them and keeps the original; else the original is replaced too."""
    joined = catalog.patterns.join(new.select("id", F.col("items").alias("_i"), F.col("duration").alias("_d")), "id", "left")
    hit = F.col("_d").isNotNull()
    changed = {c: F.when(hit, F.lit(0)).otherwise(F.col(c)) for c in ("head_items", "tail_items")} | {"items": F.coalesce("_i", "items"), "duration": F.coalesce("_d", "duration"), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    changed |= {"pinned": hit | F.col("pinned")} if pin else {"orig_items": F.coalesce("_i", "orig_items"), "orig_duration": F.coalesce("_d", "orig_duration")}
    return replace(catalog, patterns=joined.withColumns(changed).select(*catalog.patterns.columns))


def move_clips(catalog: Catalog, moves: DataFrame, now: float) -> Catalog:
    """moves: id, pattern_id. Both sides are recounted; a move to where a clip is changes nothing."""
    moves = moves.select("id", F.col("pattern_id").alias("_to"))
    joined = catalog.clips.join(moves, "id", "left")
    touched = joined.filter(F.col("_to") != F.col("pattern_id"))
    ids = touched.select(F.col("pattern_id").alias("id")).union(touched.select("_to"))
    moved = replace(catalog, clips=joined.withColumn("pattern_id", F.coalesce("_to", "pattern_id")).select(*catalog.clips.columns))
    return recount_shows(moved, materialize(ids.distinct(), "touched"), now)


def new_group(catalog: Catalog, clip_id: int, now: float, status: str = "pending") -> tuple[Catalog, int]:
    """A clip becomes a pinned pattern of its own, from its file's stored fingerprint; the new pattern's id."""
    source = catalog.clips.filter(F.col("id") == clip_id).join(catalog.fingerprints.select("file_path", "folder", "bits", "item_sec", "items"), "file_path")
    source = source.join(catalog.patterns.select(F.col("id").alias("pattern_id"), "library"), "pattern_id", "left")
    new = source.select("library", "folder", "bits", "item_sec", slice_seconds(F.col("items"), F.col("item_sec"), F.col("start"), F.col("end")).alias("items"), (F.col("end") - F.col("start")).alias("duration"), F.lit(status).alias("status"), F.lit(True).alias("pinned"))
    new = materialize(new, "new-group")
    row = new.select(F.size("items")).first()
    if row is None:
        raise LookupError("the clip's file has no stored fingerprint")
    if not row[0]:
        raise ValueError("the clip is too short to hold an item")
    made = add_patterns(catalog, new, now, ["folder"])
    new_id = (catalog.patterns.agg(F.max("id")).first()[0] or 0) + 1
    moves = catalog.clips.sparkSession.createDataFrame([(clip_id, new_id)], "id long, pattern_id long")
    return move_clips(made, moves, now), new_id


def unknown_clips(candidates: DataFrame, clips: DataFrame) -> DataFrame:
    """Candidates (pattern_id, file_path, start, ...) without a clip of their pattern and file that starts within a second."""
    there = clips.select(F.col("pattern_id").alias("_pattern"), F.col("file_path").alias("_path"), F.col("start").alias("_start"))
    same = (F.col("pattern_id") == F.col("_pattern")) & (F.col("file_path") == F.col("_path"))
    return candidates.join(there, same & (F.abs(F.col("start") - F.col("_start")) < SAME_START), "left_anti")


def apart(candidates: DataFrame) -> DataFrame:
    """Of candidates (pattern_id, file_path, start, ...) of one pattern and file, in order of start, those a second or more after the last kept.

    An occurrence added a moment ago counts as one that is there. A pattern has few in a file.
    """
    rest = [c for c in candidates.columns if c not in ("pattern_id", "file_path", "start")]
    rows = F.sort_array(F.collect_list(F.struct("start", *rest)))
    grouped = candidates.groupBy("pattern_id", "file_path").agg(rows.alias("_rows"))
    far = lambda kept, s: F.coalesce(s - F.get(kept, F.size(kept) - 1) >= SAME_START, F.lit(True))
    starts = F.aggregate(F.transform("_rows", lambda r: r["start"]), F.array().cast("array<double>"), lambda kept, s: F.when(far(kept, s), F.concat(kept, F.array(s))).otherwise(kept))
    first = lambda r, i: (i == 0) | (F.get(F.col("_rows"), i - 1)["start"] != r["start"])
    kept = grouped.withColumn("_starts", starts).withColumn("_kept", F.filter("_rows", lambda r, i: F.array_contains(F.col("_starts"), r["start"]) & first(r, i)))
    return kept.select("pattern_id", "file_path", F.inline("_kept")).select(*candidates.columns)


def new_clips(candidates: DataFrame, clips: DataFrame) -> DataFrame:
    """Candidates that become clips one after another: none within a second of a clip that is there or was just added."""
    return apart(unknown_clips(candidates, clips))


def clips_of(clips: DataFrame, pattern_id: int) -> DataFrame:
    return clips.filter(F.col("pattern_id") == pattern_id).orderBy("start", "id")


def processed_latest(processed: DataFrame) -> DataFrame:
    """Newest first."""
    return processed.orderBy(F.desc("id"))


def known_files(catalog: Catalog, files: DataFrame) -> DataFrame:
    """``files`` (file_path, ...) with has_fingerprint and is_processed."""
    out = files
    for name, table in (("has_fingerprint", catalog.fingerprints), ("is_processed", catalog.processed)):
        there = table.select("file_path").distinct().withColumn("_there", F.lit(True))
        out = out.join(there, "file_path", "left").withColumn(name, F.coalesce("_there", F.lit(False))).drop("_there")
    return out


def ordered_for_review(patterns: DataFrame) -> DataFrame:
    """By review state, pending first, then by id."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), F.lit(0))
    return patterns.orderBy(rank, "id")


def set_preview(catalog: Catalog, previews: DataFrame) -> Catalog:
    """previews: id, preview."""
    joined = catalog.clips.join(previews.select("id", F.col("preview").alias("_p")), "id", "left")
    return replace(catalog, clips=joined.withColumn("preview", F.coalesce("_p", "preview")).select(*catalog.clips.columns))


def payload(patterns: DataFrame, clips: DataFrame) -> DataFrame:
    """A row per pattern with its clips, by start; bounds and durations to two places."""
    moved = lambda c: F.abs(F.coalesce(c, F.lit(0.0)) - F.coalesce(f"orig_{c}", c, F.lit(0.0))) > 0.05
    clip = F.struct("id", "file_name", "file_path", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), (moved("start") | moved("end")).alias("edited"), F.coalesce(F.col("preview") != "", F.lit(False)).alias("has_preview"))
    keyed = F.struct(F.col("start").alias("at"), F.col("id").alias("by"), clip.alias("clip"))
    grouped = clips.groupBy(F.col("pattern_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(keyed)), lambda x: x["clip"]).alias("clips"))
    out = patterns.join(grouped, "id", "left").select("id", "folder", "status", F.round("duration", 2).alias("duration"), "shows", "bits", "pinned", "clips")
    return out.withColumn("clips", F.coalesce("clips", F.array()))


def clock(seconds: Column) -> Column:
    """h:mm:ss or m:ss, rounded half to even."""
    t = F.rint(F.coalesce(seconds, F.lit(0.0))).cast("long")
    h, m, s = F.floor(t / 3600).cast("long"), F.floor(t % 3600 / 60).cast("long"), t % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s))).otherwise(F.concat_ws(":", m.cast("string"), two(s)))


def export_json(catalog: Catalog, now: float) -> DataFrame:
    """Lines of JSON: a head with the counts, then every row of each table but the fingerprints."""
    spark = catalog.patterns.sparkSession
    head = spark.createDataFrame([(1, now)], "version int, exported_at double").select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("id"), F.to_json(F.struct("version", "exported_at")).alias("line"))
    for k, name in enumerate(("patterns", "clips", "processed"), 1):
        df = getattr(catalog, name)
        head = head.union(df.select(F.lit(k), "id", F.to_json(F.struct(F.lit(name).alias("table"), *df.columns), {"ignoreNullFields": "false"})))
    return head


def export_markdown(patterns: DataFrame, clips: DataFrame, processed: DataFrame) -> DataFrame:
    """(part, id, at, line): the lines of a report, in the order of the first three columns."""
    spark = patterns.sparkSession
    fixed = lambda part, *lines: spark.createDataFrame([(part, 0, k, x) for k, x in enumerate(lines)], "part int, id long, at int, line string")
    counts = patterns.agg(F.count(F.lit(1)).alias("p")).crossJoin(clips.agg(F.count(F.lit(1)).alias("c"))).crossJoin(processed.agg(F.count(F.lit(1)).alias("f")))
    head = counts.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("at"), F.format_string("_%d patterns · %d clips · %d processed files_", "p", "c", "f").alias("line"))
    none = lambda part, c, text: counts.filter(F.col(c) == 0).select(F.lit(part), F.lit(0).cast("long"), F.lit(0), F.lit(text))
    listed = patterns.select(F.lit(3), "id", F.lit(0), F.concat(F.lit("- **"), F.coalesce("status", F.lit("pending")), F.lit("** · "), "folder", F.lit(" · "), clock(F.col("duration")), F.lit(" · seen in "), F.col("shows").cast("string"), F.lit(" file(s) `#"), F.col("id").cast("string"), F.lit("`")))
    done = processed.select("id", F.concat(F.lit("- `"), "file_name", F.lit("` — saved "), clock(F.col("saved_sec"))).alias("line"), F.transform("removed", lambda r: F.concat(F.lit("  - "), clock(r["start"]), F.lit(" → "), clock(r["end"]))).alias("cuts"))
    removed = done.select("id", F.posexplode(F.concat(F.array("line"), F.coalesce("cuts", F.array().cast("array<string>")))).alias("at", "line")).select(F.lit(5), "id", "at", "line")
    parts = (fixed(0, "# Catalogue export", ""), head, fixed(2, "", "## Patterns", ""), none(3, "p", "_No patterns catalogued yet._"), listed, fixed(4, "", "## Removed segments", ""), none(5, "f", "_Nothing trimmed yet._"), removed)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
