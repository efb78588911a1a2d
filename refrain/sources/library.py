"""Media libraries: listing, probing and fingerprinting files.

Listing reads names and sizes only. Probing and fingerprinting call external tools on the
executors, a file at a time; what a tool prints is parsed by Spark. A file that fails keeps
its error and doesn't stop the others.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.bits import frame_hashes
from refrain.functions.media import classify_ext, file_name, parsed_fingerprint, probed

#: The folder of files in the root itself, tools' time limit, frames a second and their size.
ROOT = "(root)"
TIMEOUT_S = 600
FRAMES_PER_SECOND = 4
FRAME = (9, 8)
TOOLS = ("ffmpeg", "ffprobe", "fpcalc")


def which(tool: str) -> str | None:
    return shutil.which(tool)


def detect_tools() -> dict[str, str | None]:
    """Where each external tool is, or None."""
    return {tool: which(tool) for tool in TOOLS}


def tool_status(tools: dict[str, str | None]) -> dict[str, bool]:
    """What can be done: cutting takes both programs of its package."""
    return {"ffmpeg": bool(tools.get("ffmpeg") and tools.get("ffprobe")), "fpcalc": bool(tools.get("fpcalc"))}


def run_tool(command: Sequence[str]) -> bytes:
    """A tool's output; the error names it and has the last lines it wrote."""
    done = subprocess.run(list(command), capture_output=True, timeout=TIMEOUT_S, check=False)
    if done.returncode:
        lines = (done.stderr or done.stdout).decode(errors="replace").strip().splitlines()[-4:]
        raise RuntimeError(f"{os.path.basename(command[0])} failed (exit {done.returncode})" + (": " + " | ".join(lines) if lines else ""))
    return done.stdout


def scan_library(spark: SparkSession, root: str, skip: Sequence[str] = ("_trimmed", "_previews")) -> DataFrame:
    """(folder, file_path, file_name, kind, size) of media files: first-level folders, read in depth.

    Hidden entries of the root, hidden and output folders are skipped; hidden files within a
    folder are not. In order of folder and name, regardless of case.
    """
    files = spark.createDataFrame(_listed(spark, root), "file_path string, relative string, length long")
    relative = F.col("relative")
    parts = F.split(relative, "/")
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    hidden = F.exists(inner, lambda p: p.startswith(".") | p.isin(*skip)) | F.get(parts, 0).startswith(".")
    listed = files.withColumn("kind", classify_ext(relative)).filter(F.col("kind").isNotNull() & ~hidden)
    named = listed.select(F.when(F.size(parts) > 1, F.get(parts, 0)).otherwise(ROOT).alias("folder"), "file_path", file_name(relative).alias("file_name"), "kind", F.col("length").alias("size"))
    return named.orderBy(F.lower("folder"), "folder", F.lower("file_name"), "file_path")


def _listed(spark: SparkSession, root: str) -> list[tuple[str, str, int]]:
    """(path, path within the root, bytes) by the file system's own listing: Spark's readers pass over hidden files."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    found, files = [], fs.listFiles(top, True)
    while files.hasNext():
        f = files.next()
        path = f.getPath().toString()
        found.append((path, path.removeprefix(base), f.getLen()))
    return found


def folders(files: DataFrame) -> DataFrame:
    """(folder, kind, n_files): a folder with any video is one of video."""
    return files.groupBy("folder").agg(F.when(F.bool_or(F.col("kind") == "video"), "video").otherwise("audio").alias("kind"), F.count(F.lit(1)).alias("n_files"))


def _tool_output(files: DataFrame, command) -> DataFrame:  # noqa: ANN001
    """files with ``output`` (binary) and ``error`` of ``command(path)``; local paths."""
    fields = files.schema.simpleString()[7:-1].replace(":", " ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, errors = [], []
            for path in pdf["file_path"]:
                try:
                    out.append(run_tool(command(path.removeprefix("file:"))))
                    errors.append(None)
                except Exception as e:  # a file's failure is its row's
                    out.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pdf.assign(output=out, error=errors)

    return files.mapInPandas(run, f"{fields}, output binary, error string")


def probe(files: DataFrame, tool: str | None = None) -> DataFrame:
    """``files`` with kind and duration; those of the extension and 0 where there is no tool or it fails."""
    tool = tool or which("ffprobe")
    if tool is None:
        return files.withColumns({"kind": F.coalesce(classify_ext(F.col("file_path")), F.lit("audio")), "duration": F.lit(0.0)})
    run = _tool_output(files, lambda path: [tool, "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams", path])
    found = run.withColumn("_p", probed(F.decode("output", "UTF-8"), F.col("file_path")))
    return found.withColumns({"kind": F.col("_p.kind"), "duration": F.col("_p.duration")}).drop("_p", "output", "error")


def fingerprint_audio(files: DataFrame, tool: str | None = None) -> DataFrame:
    """``files`` with bits, item_sec, items, error."""
    tool = tool or which("fpcalc") or "fpcalc"
    run = _tool_output(files, lambda path: [tool, "-raw", "-length", "100000", path])
    found = run.withColumn("_f", parsed_fingerprint(F.decode("output", "UTF-8")))
    items = F.col("_f.items")
    error = F.when(F.col("error").isNull() & (F.coalesce(F.size(items), F.lit(0)) == 0), "the tool found no fingerprint").otherwise(F.col("error"))
    return found.withColumns({"bits": F.lit(32), "item_sec": F.col("_f.item_sec"), "items": items, "error": error}).drop("_f", "output")


def fingerprint_video(files: DataFrame, tool: str | None = None, fps: int = FRAMES_PER_SECOND) -> DataFrame:
    """``files`` with bits, item_sec, items (a hash a frame), error."""
    tool = tool or which("ffmpeg") or "ffmpeg"
    run = _tool_output(files, lambda path: [tool, "-v", "error", "-i", path, "-vf", f"fps={fps},scale={FRAME[0]}:{FRAME[1]},format=gray", "-f", "rawvideo", "-"])
    return run.withColumns({"bits": F.lit(64), "item_sec": F.lit(1.0 / fps), "items": frame_hashes(F.col("output"), *FRAME)}).drop("output")


def fingerprint(files: DataFrame, **tools: str) -> tuple[DataFrame, DataFrame]:
    """(fingerprints, failures). Audio by its sound; video too, and by its frames where that fails."""
    sound = fingerprint_audio(files, tools.get("fpcalc"))
    mute = sound.filter(F.col("error").isNotNull() & (F.col("kind") == "video"))
    frames = fingerprint_video(mute.select(*files.columns), tools.get("ffmpeg"))
    done = sound.filter(F.col("error").isNull() | (F.col("kind") != "video")).unionByName(frames.select(*sound.columns))
    return done.filter(F.col("error").isNull()).drop("error"), done.filter(F.col("error").isNotNull()).select("file_path", "error")
