"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every document.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and any character
beyond ASCII. A window is ``n`` consecutive words of an item, or the whole item where it
has fewer. The set is a sorted array of the windows' 64-bit hashes, with where each window
stands in the benchmark: some 20 bytes a window. Document windows are looked up in it, and a
hit is verified by the words themselves.

The benchmark's size is measured before anything of it is collected. Beyond ``block_bytes``
it is taken in blocks: documents are numbered and stored once, every block is a scan of them
that returns hits only, and the hits are brought together by number.

Defined results: a null or wordless text has no words and no hits; a null or wordless item
has no window; an item without id is named by the empty string, and rows with the same id
(or none) are one item. Repeated documents are judged alike; an empty benchmark hits nothing,
an empty table gives an empty result. Columns of documents named like an output are replaced
by ``find_contamination``; ``decontaminate`` returns the documents' own columns, whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.sources.shared import materialize

#: Bytes of benchmark text that one broadcast set is built from (some 100 MB in a worker at most); a larger benchmark goes in blocks.
BLOCK_BYTES = 8_000_000

#: Lower-cases A-Z, keeps a-z, 0-9 and bytes from 0x80 on, blanks the rest.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_HITS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("hits", _HITS)])
FOUND_TYPE = "n_words long, hits array<struct<start: long, length: long, item: string>>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class WindowSet:
    """The items' windows, ready to be looked up."""

    def __init__(self, items: list[tuple[str, str | None]], n: int) -> None:
        from xxhash import xxh3_64_intdigest

        self.items: list[str] = []
        self.vocabulary: set[bytes] = set()
        bodies, hashes, places, owners, sizes = [], [], [], [], []
        lengths, at = set(), 0
        for name, text in items:
            w = words(text)
            if not w:
                continue
            size = min(n, len(w))
            lengths.add(size)
            self.vocabulary.update(w)
            body = b" ".join(w)
            ends = np.cumsum([len(x) + 1 for x in w]) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            windows = list(zip(begins[: len(w) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True))
            hashes.append(np.array([xxh3_64_intdigest(body[i:j]) for i, j in windows], np.uint64))
            places.append(np.array([at + i for i, _ in windows], np.int64))
            sizes.append(np.array([j - i for i, j in windows], np.int32))
            owners.append(np.full(len(windows), len(self.items), np.int32))
            bodies.append(body)
            at += len(body)
            self.items.append(name)
        self.body = b"".join(bodies)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hashes, self.places, self.sizes, self.owners = join(hashes, np.uint64), join(places, np.int64), join(sizes, np.int32), join(owners, np.int32)
        order = np.lexsort((self.places, self.hashes))
        self.hashes, self.places, self.sizes, self.owners = (x[order] for x in (self.hashes, self.places, self.sizes, self.owners))
        self.lengths = sorted(lengths)
        # only a stretch of words that all occur in the benchmark can hold a window
        self.stretch = re.compile(b"\x01{%d,}" % min(lengths)) if lengths else None

    def owners_of(self, grams: list[bytes]) -> Iterator[tuple[int, int]]:
        """(position in ``grams``, item) of each gram that is a window of an item."""
        from xxhash import xxh3_64_intdigest

        wanted = np.fromiter(map(xxh3_64_intdigest, grams), np.uint64, len(grams))
        first = np.searchsorted(self.hashes, wanted)
        hit = np.flatnonzero(self.hashes[np.minimum(first, len(self.hashes) - 1)] == wanted)
        for k in hit.tolist():
            at, h, gram, seen = int(first[k]), wanted[k], grams[k], -1
            while at < len(self.hashes) and self.hashes[at] == h:
                place, item = int(self.places[at]), int(self.owners[at])
                # an item's repeated windows follow each other
                if item != seen and self.sizes[at] == len(gram) and self.body.startswith(gram, place):
                    seen = item
                    yield k, item
                at += 1

    def find(self, w: list[bytes]) -> list[tuple[int, int, str]]:
        """(start, length, item) of every covered stretch, adjoining windows of an item in one."""
        if self.stretch is None:
            return []
        found: dict[int, list[list[int]]] = defaultdict(list)
        for m in self.stretch.finditer(bytes(map(self.vocabulary.__contains__, w))):
            for size in self.lengths:
                grams = [b" ".join(w[i : i + size]) for i in range(m.start(), m.end() - size + 1)]
                for k, item in self.owners_of(grams) if grams else ():
                    i = m.start() + k
                    spans = found[item]
                    if spans and spans[-1][0] <= i <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], i + size)
                    else:
                        spans.append([i, i + size])
        return [(a, b - a, self.items[k]) for k, spans in found.items() for a, b in spans]


def _finder(df: DataFrame, items: list[tuple[str, str | None]], n: int):  # noqa: ANN202
    shared = df.sparkSession.sparkContext.broadcast(WindowSet(items, n))

    @F.arrow_udf(FOUND_TYPE)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for texts in batches:
            out = []
            for t in texts:
                w = words(t.as_py())
                out.append((len(w), [{"start": a, "length": k, "item": name} for a, k, name in known.find(w)]))
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], _HITS)], fields=list(_FOUND))

    return find


def covered(hits: Column) -> Column:
    """Words inside any of the hits, each once."""
    return F.aggregate(
        F.sort_array(hits),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, h: F.struct(F.greatest(a["end"], h["start"] + h["length"]).alias("end"), (a["n"] + F.greatest(h["start"] + h["length"] - F.greatest(a["end"], h["start"]), F.lit(0).cast("long"))).alias("n")),
        lambda a: a["n"],
    )


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with n_words, hits (array of start, length, item), n_hit, items (sorted) and contaminated."""
    outputs = ("n_words", "hits", "n_hit", "items", "contaminated")
    own = [c for c in df.columns if c not in outputs]
    rows = df.select(F.col(f"`{text}`").alias("text"), F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own))).alias("row"))
    found = _found(rows, benchmark, item_id, item_text, n, block_bytes)
    hits = F.col("hits")
    made = {"n_words": F.col("n_words"), "hits": hits, "n_hit": covered(hits), "items": F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["item"]))), "contaminated": F.size(hits) > 0}
    return found.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(own)), *(made[c].alias(c) for c in outputs))


def _found(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, n: int, block_bytes: int) -> DataFrame:
    """rows (text, row) with n_words and hits."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text}`").alias("body"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("body"), F.lit(0)) + 32)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    if blocks == 1:
        found = rows.withColumn("_found", _finder(rows, [tuple(r) for r in items.collect()], n)(F.col("text")))
        return found.select("row", "_found.n_words", "_found.hits")
    stored = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "numbered")  # rows keep their numbers
    block = F.pmod(F.xxhash64("item", "body"), F.lit(blocks))
    parts = []
    for k in range(blocks):
        seen = _finder(stored, [tuple(r) for r in items.filter(block == k).collect()], n)(F.col("text"))
        parts.append(materialize(stored.select("at", seen.alias("f")).filter(F.size("f.hits") > 0).select("at", "f.hits"), "block-hits"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    # a document has at most one row of hits a block
    hits = hits.groupBy("at").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    counted = stored.withColumn("n_words", _finder(stored, [], n)(F.col("text"))["n_words"])
    return counted.join(hits, "at", "left").select("row", "n_words", F.coalesce("hits", F.array().cast("array<struct<start: long, length: long, item: string>>")).alias("hits"))


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """``df`` without contaminated documents (remove="documents") or without the covered words (remove="spans").

    With "spans" the text becomes its remaining normalised words, joined by one space.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    found = _found(df.select(F.col(f"`{text}`").alias("text"), row), benchmark, **({"item_id": "item_id", "item_text": "text", "n": 10, "block_bytes": BLOCK_BYTES} | options))
    if remove == "documents":
        return found.filter(F.size("hits") == 0).select("row.*")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")

    @F.arrow_udf("string")
    def without(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(texts.to_pylist(), hits.to_pylist(), strict=True):
            w = words(t)
            for s in spans or ():
                w[s["start"] : s["start"] + s["length"]] = [b""] * s["length"]
            out.append(t if not spans else b" ".join(x for x in w if x).decode())
        return pa.array(out, pa.string())

    kept = found.withColumn("_kept", without(F.col(f"row.`{text}`"), F.col("hits")))
    return kept.select(*(F.col("_kept").alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns))
