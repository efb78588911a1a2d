"""Progress events of a scan as a projection: percent, time left and message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Percent up to which fingerprinting runs, where detection starts and ends, what a preview adds, and the most before the end.
FINGERPRINT_SHARE = 0.8
DETECT_FROM, DETECT_TO = 82.0, 97.0
PREVIEW_STEP, MOST = 0.2, 99.0


def enriched(events: DataFrame) -> DataFrame:
    """events: stage, file, index, total, elapsed (seconds since the stage's start), previews so far.

    Adds percent and eta_seconds; null where a stage says nothing about them.
    """
    total = F.when(F.col("total") > 0, F.col("total")).otherwise(F.lit(1))
    stage = F.col("stage")
    percent = (
        F.when(stage == "fingerprint", F.col("index") / total * FINGERPRINT_SHARE * 100)
        .when(stage == "detect", F.lit(DETECT_FROM))
        .when(stage == "detect_progress", F.col("index") / total * (DETECT_TO - DETECT_FROM) + DETECT_FROM)
        .when(stage == "normalize", F.lit(DETECT_TO))
        .when(stage == "preview", F.least(F.lit(MOST), F.col("previews") * PREVIEW_STEP + DETECT_TO))
        .when(stage == "done", F.lit(MOST))
    )
    eta = F.when(stage.isin("fingerprint", "detect_progress") & (F.col("index") >= 1), F.rint(F.col("elapsed") / F.col("index") * (total - F.col("index"))).cast("long"))
    said = {
        "fingerprint": F.concat(F.lit("Fingerprinting "), "file"),
        "detect": F.lit("Finding recurring segments"),
        "detect_progress": F.concat_ws(" of ", F.col("index").cast("string"), F.col("total").cast("string")),
        "matched": F.concat(F.lit("Matched a confirmed segment in "), "file"),
        "found": F.concat(F.lit("New segment in "), "file"),
        "normalize": F.lit("Aligning segment lengths"),
        "preview": F.concat(F.lit("Preview of "), "file"),
        "error": F.concat(F.lit("Skipped "), "file"),
        "done": F.lit("Finalising"),
    }
    message = F.lit(None).cast("string")
    for name, text in said.items():
        message = F.when(stage == name, text).otherwise(message)
    return events.withColumns({"percent": F.round(percent, 1), "eta_seconds": eta, "message": message})
