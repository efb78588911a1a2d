"""New fingerprints as they arrive, against the confirmed patterns of a catalogue: stream with static, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refrain.operators.catalog import SCHEMAS, new_clips
from refrain.operators.reconcile import known_occurrences
from refrain.plans.params import DetectParams

CLIP = "pattern_id long, file_path string, start double, end double"


def watch_fingerprints(spark: SparkSession, incoming: str, patterns: DataFrame, out: str, checkpoint: str, params: DetectParams | None = None, trigger: dict | None = None, clips: DataFrame | None = None) -> StreamingQuery:
    """Each new file of fingerprints under ``incoming`` is matched; new clips go to ``out`` by batch.

    Places that a stored clip marks, one of ``clips`` or of an earlier batch, are skipped. A batch
    writes its own folder and overwrites it when repeated, so each clip is written once.
    """
    dials = params or DetectParams()
    confirmed = patterns.filter((patterns["status"] == "confirmed") & (patterns["duration"] >= dials.min_seconds))
    stored = clips.select("pattern_id", "file_path", "start") if clips is not None else spark.createDataFrame([], CLIP).select("pattern_id", "file_path", "start")

    def matched(batch: DataFrame, number: int) -> None:
        known = stored
        if number:
            earlier = spark.read.schema(f"{CLIP}, batch long").option("basePath", out).parquet(out)
            known = stored.union(earlier.filter(F.col("batch") < number).select("pattern_id", "file_path", "start"))
        new_clips(known_occurrences(confirmed, batch, dials), known).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(SCHEMAS["fingerprints"]).parquet(incoming)
    return stream.writeStream.foreachBatch(matched).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
