"""Plans for cutting confirmed segments out of media and for previews; encoding itself is another tool's task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.functions.media import extension
from refrain.operators import intervals

#: Encoder and extension of re-encoded output by the source's extension.
ENCODERS = {
    "mp3": ("libmp3lame", "mp3"), "m4a": ("aac", "m4a"), "m4b": ("aac", "m4a"), "aac": ("aac", "m4a"), "mp4": ("aac", "m4a"),
    "opus": ("libopus", "opus"), "ogg": ("libvorbis", "ogg"), "oga": ("libvorbis", "ogg"), "flac": ("flac", "flac"), "wav": ("pcm_s16le", "wav"),
}
#: Any other source, and those that take no bit rate.
FALLBACK = ("aac", "m4a")
LOSSLESS = ("flac", "pcm_s16le")


def confirmed_ranges(patterns: DataFrame, clips: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file_path, start, end) of confirmed patterns' clips, in the chosen files (file_path) or all."""
    sure = patterns.filter(F.col("status") == "confirmed").select(F.col("id").alias("pattern_id"))
    ranges = clips.join(sure, "pattern_id", "left_semi").select("file_path", "start", "end")
    return ranges if files is None else ranges.join(files.select("file_path"), "file_path", "left_semi")


def remove_plan(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """A row per file with ranges: removed and keep (arrays of start, end), saved_sec, encoder, out_ext, error.

    files: file_path, kind, duration. Where nothing would be left (a duration of 0, too), the
    row says so in ``error`` and the others go on.
    """
    span = F.struct("start", "end")
    sorted_spans = lambda name: F.sort_array(F.collect_list(span)).alias(name)
    per_file = ranges.groupBy("file_path").agg(sorted_spans("removed"))
    whole = files.join(per_file.select("file_path"), "file_path", "left_semi")
    keep = intervals.complement(ranges, whole, ["file_path"]).groupBy("file_path").agg(sorted_spans("keep"))
    saved = intervals.saved_seconds(ranges, ["file_path"]).withColumnRenamed("saved", "saved_sec")
    out = whole.join(per_file, "file_path").join(keep, "file_path", "left").join(saved, "file_path", "left")
    table = F.create_map(*(x for ext, pair in ENCODERS.items() for x in (F.lit(ext), F.struct(F.lit(pair[0]).alias("encoder"), F.lit(pair[1]).alias("ext")))))
    chosen = F.coalesce(F.try_element_at(table, extension(F.col("file_path"))), F.struct(F.lit(FALLBACK[0]).alias("encoder"), F.lit(FALLBACK[1]).alias("ext")))
    video = F.col("kind") == "video"
    encoder = F.when(video, "aac").otherwise(chosen["encoder"])
    return out.select(
        "file_path", "removed", F.coalesce("keep", F.array().cast("array<struct<start:double,end:double>>")).alias("keep"), F.coalesce("saved_sec", F.lit(0.0)).alias("saved_sec"),
        encoder.alias("encoder"), F.when(video, "mp4").otherwise(chosen["ext"]).alias("out_ext"), F.when(encoder.isin(*LOSSLESS), F.lit(None)).otherwise("192k").alias("bitrate"),
        F.when(F.col("keep").isNull(), "removing the requested segments would leave nothing").alias("error"),
    )


def preview_plan(clips: DataFrame) -> DataFrame:
    """(id, file_path, seek, seconds): where to cut each clip's preview."""
    return clips.select("id", "file_path", F.greatest(F.lit(0.0), "start").alias("seek"), F.greatest(F.lit(0.2), F.col("end") - F.col("start")).alias("seconds"))


def trimmed_flags(files: DataFrame, processed: DataFrame) -> DataFrame:
    """``files`` with whether a processed file has the same name."""
    names = processed.select("file_name").distinct().withColumn("_done", F.lit(True))
    return files.join(names, "file_name", "left").withColumn("trimmed", F.coalesce("_done", F.lit(False))).drop("_done")
