"""The driver's tables as streams, patterns and clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.bits import shingle_items
from refrain.plans.params import DetectParams
from refrain.sources.shared import materialize, spread

#: One item is one shingle and lasts a second: segments of ten shingles and more, gaps of one.
TEXT_PARAMS = DetectParams(min_seconds=10.0, max_gap_seconds=1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _streams(df: DataFrame, folder: str | None, file: str) -> DataFrame:
    scope = ["folder"] if folder else []
    texts = spread(df.select(*([F.col(folder).alias("folder")] if folder else []), F.col(file).alias("file"), "text"))
    found = texts.select(*scope, "file", F.col("file").alias("idx"), F.lit(32).alias("bits"), F.lit(1.0).alias("item_sec"), shingle_items(F.coalesce("text", F.lit(""))).alias("items"))
    # a stored stream, like any fingerprint: hashed once, read as often as the matcher needs it
    # and filtered afterwards: before, the optimizer would hash once more to filter, and that in the scan's few tasks
    stored = materialize(found, "streams")
    kept = stored.filter(F.size("items") > 0)
    kept._refrain_path = stored._refrain_path  # for ``discard``
    return kept


def document_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's word shingles; its source is the folder."""
    return _streams(table(spark, sf_dir, "documents"), "source", "doc_id")


def benchmark_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's word shingles, of no folder."""
    return _streams(table(spark, sf_dir, "benchmark"), None, "item_id").withColumn("duration", F.size("items") * F.col("item_sec"))


def event_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, file, pattern_id, start, end): an event as a range of seconds of its user's stream."""
    e = table(spark, sf_dir, "events")
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / F.lit(1_000_000.0)
    kind = F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(40))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("file"), kind.alias("pattern_id"), start.alias("start"), (start + F.col("value") * 60.0).alias("end"))


def event_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, folder, status): the events' 40 patterns."""
    ids = event_ranges(spark, sf_dir).select(F.col("pattern_id").alias("id")).distinct()
    status = F.when(F.col("id") % 4 == 0, "confirmed").when(F.col("id") % 4 == 1, "dismissed").otherwise("pending")
    return ids.select("id", F.lit("f").alias("folder"), status.alias("status"))
