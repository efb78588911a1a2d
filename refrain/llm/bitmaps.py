"""Bitmaps of a fixed size over hashed keys: which rows of a scan may stay where they are.

A key marks the bit that its hash names. A row whose bit isn't set has no such key; one whose
bit is set may have it. The bitmap is built by aggregation and never larger than ``bits / 8``
bytes, so it may be broadcast at any size of the table; when a table has far more keys than
bits, more rows are held for possible hits and the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.sources.shared import materialize

#: Bits of a bitmap by default: 16 MB.
BITS = 1 << 27
#: Fixed value: bits of one chunk of Spark's bitmap functions.
CHUNK = 1 << 15


def _place(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits))


def marks(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """(_chunk, _bitmap) of a hash column, in at most ``bits / 32768`` rows of 4 KB."""
    placed = keys.select(_place(key, bits).alias("place"))
    chunks = placed.select(F.floor(F.col("place") / CHUNK).cast("int").alias("_chunk"), (F.col("place") % CHUNK).alias("bit"))
    return materialize(chunks.groupBy("_chunk").agg(F.bitmap_construct_agg("bit").alias("_bitmap")), "bitmap")


def flagged(df: DataFrame, key: Column, marked: DataFrame, out: str, bits: int = BITS) -> DataFrame:
    """``df`` with boolean ``out``: false only where ``key`` was certainly not among the marked."""
    placed = df.withColumn("_place", _place(key, bits)).withColumn("_chunk", F.floor(F.col("_place") / CHUNK).cast("int"))
    at = (F.col("_place") % CHUNK).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = placed.join(F.broadcast(marked), "_chunk", "left")
    return found.withColumn(out, F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))).drop("_place", "_chunk", "_bitmap")
