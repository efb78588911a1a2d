"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

1. Lengths and prefix hashes are read off once, as narrow rows. Rows are counted by length.
2. Rows whose length occurs again are counted by length and prefix hash.
3. Whole texts are hashed only where both occur again. Groups are found by aggregation, which
   combines before it shuffles, so a group of any size is one row per task.

The keys that occur again are handed on as bitmaps of a fixed size, so the plan is the same
at every size of the table. A row that a bitmap lets through by chance is hashed for nothing.

Defined results: a null text counts as the empty text; of equal texts the row with the
largest id stays, a null id being smaller than any other; an empty table gives an empty
result. ``exact_groups`` speaks of ids: rows that repeat id and text share a verdict.
``exact_dedup`` speaks of rows: exactly one row of a group stays, of rows that repeat the
largest id the one with the largest hash of its columns. Other columns, whatever their
names, don't matter and pass through ``exact_dedup`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm import bitmaps
from refrain.sources.shared import materialize

#: Bits of the bitmap of lengths: 128 KB.
LENGTH_BITS = 1 << 20


def _body(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def _keys(body: Column, prefix_chars: int) -> list[Column]:
    return [F.octet_length(body).alias("_len"), F.xxhash64(F.substring(body, 1, prefix_chars)).alias("_prefix")]


def _suspects(df: DataFrame, body: Column, prefix_chars: int, bits: int) -> DataFrame:
    """Bitmap of the (length, prefix hash) pairs that occur more than once."""
    keys = materialize(df.select(*_keys(body, prefix_chars)), "dedup-keys")
    again = F.count(F.lit(1)) > 1
    lengths = keys.groupBy("_len").agg(again.alias("_again")).filter("_again")
    by_length = bitmaps.marks(lengths, F.xxhash64("_len"), LENGTH_BITS)
    shared = bitmaps.flagged(keys, F.xxhash64("_len"), by_length, "_same", LENGTH_BITS).filter("_same")
    pairs = shared.groupBy("_len", "_prefix").agg(again.alias("_again")).filter("_again")
    return bitmaps.marks(pairs, F.xxhash64("_len", "_prefix"), bits)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", prefix_chars: int = 64, all_digests: bool = False, bits: int = bitmaps.BITS) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept and sha256 (binary).

    sha256 is null for rows that can have no equal, unless ``all_digests`` asks for it. Texts
    are read twice and never shuffled.
    """
    body = _body(text)
    keyed = df.select(F.col(f"`{id_col}`").alias("id"), body.alias("_body"), *_keys(body, prefix_chars))
    found = bitmaps.flagged(keyed, F.xxhash64("_len", "_prefix"), _suspects(df, body, prefix_chars, bits), "_suspect", bits)
    digest = F.unhex(F.sha2("_body", 256))
    prints = materialize(found.select("id", "_suspect", (digest if all_digests else F.when(F.col("_suspect"), digest)).alias("sha256")), "dedup-digests")
    groups = prints.filter("_suspect").groupBy("sha256").agg(F.max("id").alias("_keep"), F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    groups = materialize(groups, "dedup-groups")
    # rows that can have no equal are in no group, and don't take part in the join
    alone = prints.filter("NOT _suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha256")
    some = prints.filter("_suspect").join(groups, "sha256", "left").withColumn("keep_id", F.when(F.col("_size").isNull(), F.col("id")).otherwise(F.col("_keep")))
    some = some.select("id", "keep_id", F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha256")
    return alone.union(some).withColumnRenamed("id", id_col)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", prefix_chars: int = 64, bits: int = bitmaps.BITS) -> DataFrame:
    """The rows of ``df`` that stay, one of each group of equal texts, with its own columns only.

    Rows that can have no equal stay where they are. Of the others the one to stay is found by
    an aggregation, so a task sends one row of each of its groups.
    """
    body = _body(text)
    told = [F.col(f"`{c}`") for c, kind in df.dtypes if c != text and "map<" not in kind and kind != "variant"]
    order = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.lit(1), *told).alias("tie"))
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), order.alias("_order"), body.alias("_body"), *_keys(body, prefix_chars))
    found = bitmaps.flagged(keyed, F.xxhash64("_len", "_prefix"), _suspects(df, body, prefix_chars, bits), "_suspect", bits)
    alone = found.filter("NOT _suspect").select("_row")
    digest = F.unhex(F.sha2("_body", 256))
    best = found.filter("_suspect").groupBy(digest.alias("sha256")).agg(F.max_by("_row", "_order").alias("_row"))
    return alone.union(best.select("_row")).select("_row.*")
