"""Scalar functions over items: unsigned 32- or 64-bit values held as signed longs."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from refrain.plans.params import KEY_BITS


def differing_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def items_match(a: Column, b: Column, max_bit_err: Column | int) -> Column:
    """Whether two items differ in no more than ``max_bit_err`` bits. Both lie within their width, so no mask is needed."""
    return differing_bits(a, b) <= max_bit_err


def seed_key(v: Column, bits: Column | int) -> Column:
    """An item's highest 16 bits."""
    if isinstance(bits, int):
        return F.shiftrightunsigned(v, bits - KEY_BITS)
    return F.when(bits == 64, F.shiftrightunsigned(v, 64 - KEY_BITS)).otherwise(F.shiftrightunsigned(v, 32 - KEY_BITS))


def unsigned(text: Column) -> Column:
    """Decimal text of an unsigned 64-bit item as a signed long."""
    return F.conv(text, 10, -10).cast("long")


def dhash(values: Column) -> Column:
    """Bit k is set where value k + 1 is greater than value k; up to 65 values."""
    n = F.size(values)
    return F.aggregate(
        F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")),
        F.lit(0).cast("long"),
        lambda h, i: h.bitwiseOR(F.when(F.element_at(values, i + 2) > F.element_at(values, i + 1), F.call_function("shiftleft", F.expr("1L"), i)).otherwise(F.expr("0L"))),
    )


def frame_hashes(frames: Column, width: int = 9, height: int = 8) -> Column:
    """One 64-bit hash per full ``width`` x ``height`` frame of gray bytes: each row's left-to-right increases, row by row."""
    size = width * height
    count = F.floor(F.octet_length(frames) / size).cast("int")
    pixels = lambda k: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.conv(F.hex(F.substring(frames, k * size + i, F.lit(1))), 16, 10).cast("int"))
    bits = [(r * width + c, r * (width - 1) + c) for r in range(height) for c in range(width - 1)]

    def hashed(k: Column) -> Column:
        return F.aggregate(
            F.array(*(F.struct(F.lit(at + 1).alias("at"), F.lit(bit).alias("bit")) for at, bit in bits)),
            F.struct(F.lit(0).cast("long").alias("h"), pixels(k).alias("p")),
            lambda acc, b: F.struct(acc["h"].bitwiseOR(F.when(F.element_at(acc["p"], b["at"] + 1) > F.element_at(acc["p"], b["at"]), F.call_function("shiftleft", F.expr("1L"), b["bit"])).otherwise(F.expr("0L"))).alias("h"), acc["p"].alias("p")),
            lambda acc: acc["h"],
        )

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), hashed)).otherwise(F.array().cast("array<long>"))


def slice_seconds(items: Column, item_sec: Column, start: Column, end: Column) -> Column:
    """Items of [start, end) seconds; bounds round half to even, as item positions do throughout."""
    i = F.greatest(F.lit(0), F.rint(start / item_sec).cast("int"))
    j = F.least(F.size(items), F.rint(end / item_sec).cast("int"))
    return F.slice(items, i + 1, F.greatest(j - i, F.lit(0)))


def trimmed(items: Column, head: Column, tail: Column) -> Column:
    """Items without their first ``head`` and last ``tail``, unless nothing would be left."""
    n = F.size(items) - tail
    return F.when(n > head, F.slice(items, head + 1, n - head)).otherwise(items)


def shingle_items(text: Column, size: int = 3) -> Column:
    """A text as a stream: one 32-bit hash, the beginning of its MD5, per ``size`` consecutive blank-separated words."""

    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                words = [] if t is None else [w for w in t.split(b" ") if w]
                grams = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
                out.append(b"".join([md5(g, usedforsecurity=False).digest()[:4] for g in grams]))
            values = pa.array(np.frombuffer(b"".join(out), ">u4").astype(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(o) // 4 for o in out])]).astype(np.int32)
            absent = np.append(texts.is_null().to_numpy(zero_copy_only=False), False)
            yield pa.ListArray.from_arrays(pa.array(ends, mask=absent), values)

    return F.arrow_udf(hashed, "array<bigint>")(text.cast("binary"))
