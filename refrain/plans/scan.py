"""A scan: known patterns, recurrence, grouping and length normalisation of a batch of stored fingerprints."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.functions.media import file_name
from refrain.operators import catalog as cat
from refrain.operators import match, reconcile
from refrain.operators.catalog import Catalog
from refrain.plans.params import DetectParams
from refrain.sources.shared import materialize


#: An event table's columns, as ``progress.enriched`` reads them.
EVENT = "stage string, file string, index int, total int, elapsed double, previews int"


def scan(catalog: Catalog, batch: DataFrame, params: DetectParams, now: float, library: str = "", progress: Callable[[DataFrame], None] | None = None, previews: Callable[[DataFrame], DataFrame] | None = None) -> Catalog:
    """batch: file_path, folder, bits, item_sec, items, idx (its order). Stored, matched and reconciled.

    ``progress`` is given rows of events (stage, file, index, total, elapsed, previews) after each
    stage; ``previews`` makes (id, preview) of the clips that a known pattern gave.
    """
    began = time.monotonic()

    def tell(stage: str, files: DataFrame | None = None) -> None:
        if progress is None:
            return
        spark, elapsed = batch.sparkSession, time.monotonic() - began
        if files is None:
            progress(spark.createDataFrame([(stage, None, 0, 0, elapsed, 0)], EVENT))
        else:
            progress(files.select(F.lit(stage).alias("stage"), file_name(F.col("file")).alias("file"), F.lit(0).alias("index"), F.lit(0).alias("total"), F.lit(elapsed).alias("elapsed"), F.lit(0).alias("previews")))

    catalog = cat.store_fingerprints(catalog, batch.drop("idx"), now).settled()
    catalog, added = reconcile.apply_known(catalog, params, now, files=batch)
    catalog = catalog.settled()
    tell("matched", added.select(F.col("file_path").alias("file")))
    if previews is not None:
        fresh = catalog.clips.join(added.select("pattern_id", "file_path", "start"), ["pattern_id", "file_path", "start"], "left_semi")
        catalog = cat.set_preview(catalog, previews(fresh)).settled()
    before = catalog.patterns.select("id")
    tell("detect")
    streams = materialize(batch.withColumnRenamed("file_path", "file"), "batch")
    found = match.recurring_segments(streams, params).join(streams.select("folder", "bits", "file", "idx"), ["folder", "bits", "file"])
    found = materialize(found, "found")
    tell("found", found.select("file"))
    catalog = reconcile.store_segments(catalog, found, params, library, now).settled()
    new = catalog.patterns.select("id").join(before, "id", "left_anti")
    tell("normalize")
    catalog = reconcile.normalize_lengths(catalog, new, params, now).settled()
    tell("done")
    return catalog


def summary(before: Catalog, after: Catalog, batch: DataFrame) -> DataFrame:
    """One row: files, new patterns and added clips of a scan."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    new = after.patterns.join(before.patterns.select("id"), "id", "left_anti")
    clips = after.clips.join(before.clips.select("id"), "id", "left_anti")
    return count(batch, "files").crossJoin(count(new, "new_patterns")).crossJoin(count(clips, "clips_added"))
