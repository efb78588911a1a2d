"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``bits`` bits differ in at most that many of
their eight bytes, so they share at least ``8 - bits`` positional bytes: the guaranteed
minimum of matches.

A list of a single positional byte would hold 1/256 of all fingerprints, and tallying such
lists grows with the square of the table. The index therefore lists fingerprints by the bytes
at one position fewer than the minimum, for every choice of positions: two fingerprints that
share m bytes meet in C(m, 8 - bits - 1) lists.

1. In lists of few entries each pair scores one. Tallied over all lists, a pair that reaches
   the minimum of matches has scored at least 8 - bits (C(m, m - 1) = m); pairs below that
   are dropped, the others verified by their bits.
2. Lists of many entries, which groups of near copies make, are split by each further
   position. Whoever meets there has the minimum, and no pair that reaches it is missed. Such a
   list fixes all but ``bits`` bytes, so it holds at most 2^(8 * bits) entries whatever the
   table; it is verified by probing each entry's few possible partners and reports a spanning
   tree of its verified links instead of all of them.

Equal fingerprints are one entry throughout.

Defined results: a null or wordless text has fingerprint 0 and links like any other; rows
without id get their component's smallest id like any other; repeated rows are judged alike;
an empty table gives an empty result. ``near_dedup`` keeps one row of each component, that
with the smallest id (of equal ids any one; a row without id only where no row has one), with
its own columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.llm.components import components
from refrain.sources.shared import materialize

SEED = 42
_CHUNK = 1 << 15
#: Entries up to which a list's pairs are scored one by one.
PAIRWISE = 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of a text's word shingles: bit set where over half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    join = b" ".join
    shingles = [join(w)] if len(w) < size else list(map(join, zip(*(w[i:] for i in range(size)), strict=False)))
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, size: int = 3) -> Column:
    @F.arrow_udf("long")
    def printed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t.as_py(), size) for t in texts], pa.int64())

    return printed(text)


def masks(positions: int) -> list[int]:
    """A mask (as a signed long) of each choice of that many byte positions."""
    return [int(np.array([sum(0xFF << (8 * p) for p in kept)], np.uint64).view(np.int64)[0]) for kept in combinations(range(8), positions)]


def index(prints: DataFrame, positions: int, column: str = "fp") -> DataFrame:
    """(fp, bytes, choice): each fingerprint in the list of its bytes at every choice of positions."""
    fp = F.col(column)
    keys = F.array(*(F.struct(fp.bitwiseAND(F.lit(m)).alias("bytes"), F.lit(k).cast("tinyint").alias("choice")) for k, m in enumerate(masks(positions))))
    return prints.select(fp.alias("fp"), F.inline(keys))


def _differences(free: np.uint64, bits: int) -> np.ndarray:
    """Every non-zero pattern of at most ``bits`` bits within ``free``."""
    places = [1 << i for i in range(64) if int(free) >> i & 1]
    return np.array([sum(c) for n in range(1, bits + 1) for c in combinations(places, n)], np.uint64)


def posting_links(entries: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(entry, smallest entry it is linked with) over a list's distinct entries, by verified links only."""
    x = np.sort(entries.view(np.uint64))
    label = np.arange(len(x))
    if len(x) <= 3 * PAIRWISE:
        i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= bits, 1))
        pairs = [(i, j)] if len(i) else []
    else:
        free = np.bitwise_or.reduce(x) ^ np.bitwise_and.reduce(x)
        pairs = []
        for d in _differences(free, bits):
            partner = x ^ d
            at = np.minimum(np.searchsorted(x, partner), len(x) - 1)
            hit = np.flatnonzero((x[at] == partner) & (partner > x))
            if len(hit):
                pairs.append((hit, at[hit]))
    if not pairs:
        return []
    a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    signed = x.view(np.int64).tolist()
    return [(signed[k], signed[r]) for k, r in enumerate(label.tolist()) if k != r]


def _tallied(few: DataFrame, least: int, bits: int) -> DataFrame:
    """(a, b): pairs that meet in at least ``least`` lists and differ in at most ``bits`` bits."""
    lists = few.groupBy("bytes", "choice").agg(F.array_sort(F.collect_list("fp")).alias("fps"))  # at most PAIRWISE entries
    later = F.transform("fps", lambda b, k: F.transform(F.slice("fps", F.lit(1), k), lambda a: F.struct(b.alias("a"), a.alias("b"))))
    pairs = lists.select(F.inline(F.flatten(later)))
    tally = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"))
    return tally.filter((F.col("lists") >= least) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")


def _split(many: DataFrame, matches: int, bits: int) -> DataFrame:
    """Verified links of the entries of long lists, by lists of one position more."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            found = [link for s, e in zip(ends, ends[1:], strict=False) for link in posting_links(values[s:e], bits)]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    entries = many.select("fp").distinct()  # with all their lists: whatever is verified there is a link
    postings = index(entries, matches).groupBy("bytes", "choice").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return postings.select("fps").mapInArrow(verified, "a long, b long")


def fingerprint_links(prints: DataFrame, column: str = "fingerprint", bits: int = 2) -> DataFrame:
    """(a, b): links whose connected components are those of all pairs of distinct fingerprints within ``bits`` bits.

    ``bits`` is from 1 to 6: with more there would be no byte left to list by.
    """
    if not 1 <= bits <= 6:
        raise ValueError("bits must be from 1 to 6")
    matches = 8 - bits
    # spread before the entries multiply: the table of fingerprints is small and in few files
    spread = prints.select(F.col(column).alias("fp")).repartition("fp")
    size = F.count(F.lit(1)).over(Window.partitionBy("bytes", "choice"))
    crowded = materialize(index(spread, matches - 1).withColumn("n", size).filter("n > 1"), "crowded-lists")
    few = crowded.filter(F.col("n") <= PAIRWISE)
    many = crowded.filter(F.col("n") > PAIRWISE)
    return _tallied(few, matches, bits).union(_split(many, matches, bits))


def _rooted(prints: DataFrame, bits: int) -> DataFrame:
    """(fingerprint, rep, root) of each distinct fingerprint: its smallest id, and its component."""
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("id").alias("rep")), "distinct-fingerprints")
    roots = components(fingerprint_links(distinct, bits=bits))
    return materialize(distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "rep", F.coalesce("root", "fingerprint").alias("root")), "rooted")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, bits: int = 2) -> DataFrame:
    """One row per row of ``df``: id, fingerprint (signed long), component_id (smallest id reachable)."""
    prints = materialize(df.select(F.col(f"`{id_col}`").alias("id"), fingerprint_column(F.col(f"`{text}`"), size).alias("fingerprint")), "fingerprints")
    rooted = _rooted(prints, bits)
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint", "left").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, bits: int = 2) -> DataFrame:
    """``df`` with one row of each component."""
    stored = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.monotonically_increasing_id().alias("at"), fingerprint_column(F.col(f"`{text}`"), size).alias("fingerprint"))
    stored = materialize(stored, "near-rows")  # rows keep their numbers
    prints = stored.select(F.col(f"row.`{id_col}`").alias("id"), "at", "fingerprint")
    # per fingerprint first, which combines before the join
    first = prints.groupBy("fingerprint").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at")).alias("best"))
    kept = first.join(_rooted(prints, bits), "fingerprint").groupBy("root").agg(F.min("best").alias("best")).select("best.at")
    return stored.select("at", "row").join(materialize(kept, "near-kept"), "at", "left_semi").select("row.*")
