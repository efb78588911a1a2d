"""Scalar functions over media names and tool outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Known extensions by kind.
AUDIO = ("mp3", "m4a", "aac", "flac", "ogg", "opus", "wav", "wma", "m4b")
VIDEO = ("mp4", "mkv", "mov", "avi", "webm", "m4v", "flv", "wmv", "ts", "mpg", "mpeg")


def extension(path: Column) -> Column:
    """Lower-case extension of a path's last part, empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def classify_ext(path: Column) -> Column:
    """'audio', 'video' or null."""
    ext = extension(path)
    return F.when(ext.isin(*AUDIO), "audio").when(ext.isin(*VIDEO), "video")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


PROBE_TYPE = "struct<format: struct<duration: string>, streams: array<struct<codec_type: string, disposition: struct<attached_pic: int>>>>"


def probed(json: Column, path: Column) -> Column:
    """struct(kind, duration) of a prober's JSON; the extension's kind (else audio) and 0 seconds where it can't be read."""
    doc = F.from_json(json, PROBE_TYPE)
    picture = lambda s: F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0
    video = F.exists(doc["streams"], lambda s: (s["codec_type"] == "video") & picture(s))
    failed = doc.isNull() | (doc["streams"].isNull() & doc["format"].isNull())
    return F.struct(
        F.when(failed, F.coalesce(classify_ext(path), F.lit("audio"))).when(F.coalesce(video, F.lit(False)), "video").otherwise("audio").alias("kind"),
        F.coalesce(F.when(failed, F.lit(0.0)).otherwise(doc["format"]["duration"].try_cast("double")), F.lit(0.0)).alias("duration"),
    )


#: Seconds of an item where a stream's duration is unknown.
DEFAULT_ITEM_SEC = 0.1238


def parsed_fingerprint(output: Column) -> Column:
    """struct(items, item_sec) of DURATION= and FINGERPRINT= lines; no items where the tool printed none."""
    listed = F.regexp_extract(output, r"(?m)^FINGERPRINT=([-0-9, ]+)$", 1)
    items = F.transform(F.filter(F.split(listed, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    duration = F.regexp_extract(output, r"(?m)^DURATION=([0-9.]+)\s*$", 1).try_cast("double")
    n = F.size(items)
    sec = F.when((duration > 0) & (n > 0), duration / n).otherwise(F.lit(DEFAULT_ITEM_SEC))
    return F.struct(items.alias("items"), sec.alias("item_sec"))
