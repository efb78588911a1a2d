"""What a reviewer does to a catalogue, each as one step from snapshot to snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.functions.media import file_name
from refrain.operators import catalog as cat
from refrain.operators import reconcile
from refrain.operators.catalog import Catalog
from refrain.plans import removal
from refrain.plans.params import DetectParams
from refrain.sources.library import detect_tools, folders, tool_status
from refrain.sources.shared import materialize

#: Fixed value: seconds by which a bound must move for clips that fit no longer to leave their group.
CROPPED = 1.0


def _one_clip(catalog: Catalog, clip_id: int) -> dict:
    row = catalog.clips.filter(F.col("id") == clip_id).first()
    if row is None:
        raise LookupError(f"no clip {clip_id}")
    return row.asDict()


def _bounded(catalog: Catalog, clip_id: int, start: float, end: float) -> Catalog:
    start, end = max(0.0, float(start)), float(end)
    if end - start < reconcile.SHORTEST:
        raise ValueError(f"a clip ends {reconcile.SHORTEST} s after its start at least")
    bounds = catalog.clips.sparkSession.createDataFrame([(clip_id, start, end)], "id long, start double, end double")
    return cat.set_bounds(catalog, bounds)


def adjust(catalog: Catalog, clip_id: int, start: float, end: float) -> Catalog:
    """New bounds of one clip: none before 0, and not too short."""
    _one_clip(catalog, clip_id)
    return _bounded(catalog, clip_id, start, end)


def reset(catalog: Catalog, clip_id: int) -> Catalog:
    _one_clip(catalog, clip_id)
    return cat.reset_clips(catalog, catalog.clips.filter(F.col("id") == clip_id).select("id"))


def relocate(catalog: Catalog, clip_id: int, params: DetectParams, now: float, start: float | None = None, end: float | None = None) -> Catalog:
    """A clip, cropped to new bounds if they are given, is found everywhere in its folder; nested clips go afterwards.

    Clips that fit no longer leave the group only where a bound moved away from the detected one.
    """
    clip = _one_clip(catalog, clip_id)
    split = False
    if start is not None and end is not None:
        detected = [clip[f"orig_{c}"] if clip[f"orig_{c}"] is not None else clip[c] for c in ("start", "end")]
        split = abs(max(0.0, float(start)) - detected[0]) > CROPPED or abs(float(end) - detected[1]) > CROPPED
        catalog = _bounded(catalog, clip_id, start, end).settled()
    folder = catalog.patterns.filter(F.col("id") == clip["pattern_id"]).first()["folder"]
    moved = reconcile.relocate_group(catalog, clip_id, params, now, split_nonmatches=split).settled()
    return reconcile.dedupe_contained(moved, now=now, folder=folder)


def remove(catalog: Catalog, files: DataFrame, out_dir: str, now: float, chosen: DataFrame | None = None) -> tuple[Catalog, DataFrame]:
    """Confirmed ranges of files (file_path, kind, duration), all or the chosen, become processed rows; and the plan.

    A file that would have nothing left keeps its error in the plan and isn't processed.
    """
    plan = materialize(removal.remove_plan(removal.confirmed_ranges(catalog.patterns, catalog.clips, chosen), files), "removal")
    stem = F.regexp_replace(file_name(F.col("file_path")), r"(?<=.)\.[^.]*$", "")
    done = plan.filter(F.col("error").isNull()).select("file_path", F.concat(F.lit(out_dir.rstrip("/") + "/"), stem, F.lit("."), "out_ext").alias("output_path"), "removed", "saved_sec")
    return cat.add_processed(catalog, done, now), plan


def status(files: DataFrame) -> DataFrame:
    """(part, name, value): tools that are there, review states, and folders with their kinds."""
    spark = files.sparkSession
    known = [("tool", name, str(there).lower()) for name, there in tool_status(detect_tools()).items()] + [("state", name, None) for name in cat.STATUSES]
    return spark.createDataFrame(known, "part string, name string, value string").union(folders(files).select(F.lit("folder"), "folder", "kind"))
