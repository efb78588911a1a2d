"""Where streams meet: all alignments of a block of streams are voted on in one task.

Keys have 16 bits, so nearly all votes are chance ones, and their number grows with the square
of a scope's items: as rows they would be far more than the streams. Here b's streams are
dealt to blocks of some ``BLOCK`` items and a's go to each block that they may meet; a task
indexes its block by key, counts a stream's votes in memory and returns what is strong. A
vote is never a row, and what is shuffled are packed streams: one copy of b and, of a, one for
each block. Where only counts are asked for, blocks meet in rounds, so that the copies that
are on disk at one time don't grow with the number of blocks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from refrain.plans.params import KEY_BITS, MARGIN, DetectParams
from refrain.sources.shared import materialize

#: Items of a block, blocks of a that one task lets it meet, items a key that make a bucket full.
BLOCK = 1 << 24
PROBES = 2
FULL = 128
#: Copies of all items that a round may shuffle, and items that it may in any case.
SHARE = 1.5
ROUND = 1 << 24
#: Votes and items that are looked at together, rows of a batch that is returned.
AT_ONCE = 1 << 22
ROWS = 1 << 14
_HASH = (1 << 16) - 1


def _packed(items: pa.Array, bits: pa.Array) -> pa.Array:
    """Items as 4 bytes each, those of 64 bits as 8."""
    values, ends = items.values.to_numpy(zero_copy_only=False), items.offsets.to_numpy()
    wide = bits.to_numpy(zero_copy_only=False) == 64
    return pa.array([values[i:j].astype(np.uint64 if w else np.uint32).tobytes() for i, j, w in zip(ends, ends[1:], wide, strict=False)], pa.binary())


class _Index:
    """A block of b's streams by key, without the buckets of over ``most`` items of one stream."""

    def __init__(self, streams: list[np.ndarray], rows: pa.Table, most: int) -> None:
        self.rows = rows
        self.sizes = np.array([len(s) for s in streams], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.shown = None
        self.items = np.concatenate(streams)
        self.shift = self.items.dtype.type(self.items.itemsize * 8 - KEY_BITS)
        keys = self.keys(self.items)
        at = np.argsort(keys, kind="stable").astype(np.int32)
        sorted_keys = keys[at]
        self.dead = np.empty(0, np.int64)
        if len(at) > most:
            # of one key, places come in order: a full bucket is where the most-th place after is of the same stream
            same = np.flatnonzero(sorted_keys[most:] == sorted_keys[:-most])
            stream = lambda x: np.searchsorted(self.starts, x, "right")
            full = [x[at[x + most] - at[x] < self.sizes.max()] for x in np.array_split(same, len(same) // AT_ONCE + 1)]
            full = np.concatenate([x[stream(at[x + most]) == stream(at[x])] for x in full])
            del same
            if len(full):
                mark = np.zeros(len(at) + 1, np.int32)
                np.add.at(mark, full, 1)
                np.add.at(mark, full + most + 1, -1)
                over = np.cumsum(mark[:-1]) > 0
                self.dead = np.sort(at[over]).astype(np.int64)
                at, sorted_keys = at[~over], sorted_keys[~over]
        self.edges = np.searchsorted(sorted_keys, np.arange((1 << KEY_BITS) + 1))
        self.at = at
        # a full bucket is copied as a whole, a small one picked place by place
        self.buckets = [at[i:j] for i, j in itertools.pairwise(self.edges.tolist())] if len(at) >= FULL << KEY_BITS else None

    def keys(self, items: np.ndarray) -> np.ndarray:
        return (items >> self.shift).astype(np.uint16)

    def living(self, s: int) -> np.ndarray:
        """Keys of a stream's indexed items."""
        i, n = self.starts[s], self.sizes[s]
        keys = self.keys(self.items[i : i + n])
        dead = self.dead[np.searchsorted(self.dead, i) : np.searchsorted(self.dead, i + n)] - i
        return np.delete(keys, dead) if len(dead) else keys

    def strong(self, items: np.ndarray, params: DetectParams, done: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """(b, off, votes, lo, hi) of a stream's strong alignments; ``done`` tells how many of each bucket's first to leave out."""
        keys = self.keys(items)
        first, last = self.edges[keys], self.edges[keys + np.int64(1)]
        if done is not None:
            first = first + done[keys]
        sizes = last - first
        total = int(sizes.sum())
        if total <= AT_ONCE:
            return self._strong(self._places(keys, first, sizes), sizes, params)
        # by stretches of the block that end with a stream
        ends = np.unique(np.searchsorted(self.starts, np.linspace(0, len(self.items), total // AT_ONCE + 2)[1:-1]))
        cuts = [0, *self.starts[ends[(ends > 0) & (ends < len(self.starts))]].tolist(), len(self.items)]
        parts = [self.at[i:j] for i, j in zip(first.tolist(), last.tolist(), strict=True)]
        found = []
        for i, j in itertools.pairwise(cuts):
            some = [p[slice(*np.searchsorted(p, (i, j)))] for p in parts]
            found.append(self._strong(np.concatenate(some), np.array([len(p) for p in some], np.int64), params))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _places(self, keys: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places in the buckets of keys, from ``first`` on."""
        if self.buckets is not None and len(keys):
            skipped = first - self.edges[keys]
            if skipped.any():
                return np.concatenate([self.buckets[k][d:] for k, d in zip(keys.tolist(), skipped.tolist(), strict=True)])
            return np.concatenate([self.buckets[k] for k in keys.tolist()])
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return self.at[at]

    def _strong(self, place: np.ndarray, sizes: np.ndarray, params: DetectParams) -> tuple[np.ndarray, ...]:
        none = (np.empty(0, np.int64),) * 5
        least = params.seed_min_votes
        if len(place) < max(1, least):
            return none
        diagonal = place - np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        some = slice(None)
        if least > 1:
            ordered = np.sort(diagonal)
            often = ordered[least - 1 :][ordered[least - 1 :] == ordered[: 1 - least]]
            if not len(often):
                return none
            table = np.zeros(_HASH + 1, np.bool_)
            table[often & _HASH] = True
            some = np.flatnonzero(table[diagonal & _HASH])
            place, diagonal = place[some], diagonal[some]
        place = place.astype(np.int64)
        # along a diagonal streams follow each other
        both = np.sort((diagonal.astype(np.int64) << 32) + place)
        diagonal, place = both >> 32, both & 0xFFFFFFFF
        edge = np.concatenate([[0], np.flatnonzero(diagonal[1:] != diagonal[:-1]) + 1, [len(both)]])
        kept = np.repeat(np.diff(edge) >= least, np.diff(edge))
        diagonal, place = diagonal[kept], place[kept]
        b = np.searchsorted(self.starts, place, "right") - 1
        first = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (diagonal[1:] != diagonal[:-1])]))
        last = np.append(first[1:], len(b)) - 1
        votes = last - first + 1
        good = (votes >= least) & (place[last] - place[first] <= votes * params.seed_max_spread)
        first, last, votes = first[good], last[good], votes[good]
        b, off = b[first], diagonal[first] - self.starts[b[first]]
        return b, off, votes, place[first] - diagonal[first], place[last] - diagonal[first]

    def runs(self, items: np.ndarray, found: tuple[np.ndarray, ...], params: DetectParams, least: int, gap: int, err: int) -> tuple[np.ndarray, ...]:
        """(b, off, start, end): verified runs of a stream's best alignments with each other stream."""
        b, off, votes, lo, hi = found
        order = np.lexsort((-off, -votes, b))
        b, off, lo, hi = b[order], off[order], lo[order], hi[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        begin = np.maximum(np.maximum(0, -off), lo - MARGIN)
        end = np.minimum(np.minimum(len(items), hi + 1 + MARGIN), self.sizes[b] - off)
        keep = (rank < params.top_offsets) & (end - begin >= max(1, least))
        b, off, begin, size = b[keep], off[keep], begin[keep], (end - begin)[keep]
        out = []
        share = np.cumsum(size) // AT_ONCE
        for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(share)) + 1):
            if not len(part):
                continue
            n = size[part]
            c = np.repeat(part, n)
            pos = np.arange(len(c)) + np.repeat(begin[part] - (np.cumsum(n) - n), n)
            hit = np.bitwise_count(items[pos] ^ self.items[(self.starts[b] + off)[c] + pos]) <= err
            c, pos = c[hit], pos[hit]
            if not len(c):
                continue
            opens = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (pos[1:] - pos[:-1] - 1 > gap)]))
            closes = np.append(opens[1:], len(c)) - 1
            start, stop = pos[opens], pos[closes] + 1
            good = (stop - start >= least) & ((closes - opens + 1) / (stop - start) >= params.min_density)
            out.append((b[c[opens]][good], off[c[opens]][good], start[good], stop[good]))
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.empty(0, np.int64),) * 4

    def show(self, found: tuple[np.ndarray, ...], size: int, s: int | None) -> np.ndarray | None:
        """Count for each position of both sides the streams that share it in ``runs``; the counts' steps of a stream of another block."""
        if self.shown is None:
            self.shown = np.zeros(len(self.items) + 1, np.int32)
        b, off, start, end = found
        at = self.starts[b] + off
        i, j = _merged(start + at, end + at)
        np.add.at(self.shown, i, 1)
        np.add.at(self.shown, j, -1)
        i, j = _merged(start + b * (size + 1), end + b * (size + 1))
        steps = np.bincount(i % (size + 1), minlength=size + 1) - np.bincount(j % (size + 1), minlength=size + 1)
        if s is None:
            return steps[:size]
        self.shown[self.starts[s] : self.starts[s] + size + 1] += steps.astype(np.int32)
        return None

    def steps(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each stream's steps of its counts."""
        if self.shown is not None:
            counts = np.cumsum(self.shown)
            for s, (i, n) in enumerate(zip(self.starts.tolist(), self.sizes.tolist(), strict=True)):
                if counts[i : i + n].any():
                    yield s, np.diff(counts[i : i + n], prepend=0)


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping ranges as one."""
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate(end[order])
    opens = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[opens], reach[np.append(opens[1:], len(start)) - 1]


def _met(params: DetectParams, scope: Sequence[str], extra: Sequence[str], ordered: bool, result: str, schema: pa.Schema):  # noqa: ANN202
    """Of rows (scope, _block, _part, _probe, _order, _a, _b, extra, _least, _gap, _err, _wide, _items), sorted by the first five."""
    place = [*scope, "_block", "_part"]

    def told(index: _Index, rows: pa.Table, k: int, items: np.ndarray, done: np.ndarray | None) -> pa.Table | None:
        """What row k of ``rows``, a stream of a, finds in the block."""
        found = index.strong(items, params, done)
        if ordered and len(found[0]):
            before = pc.less(rows.column("_order")[k], index.rows.column("_order").take(pa.array(found[0]))).to_numpy()
            found = tuple(x[before] for x in found)
        if result != "votes" and len(found[0]):
            found = index.runs(items, found, params, *(rows.column(c)[k].as_py() for c in ("_least", "_gap", "_err")))
        n = len(found[0])
        if not n:
            return None
        if result == "shows":
            steps = index.show(found, len(items), None if done is None else k)
            return None if steps is None else shows(rows, k, steps)
        at = pa.array(found[0])
        cols = [pa.repeat(rows.column(c)[k], n) for c in (*scope, "_a")] + [index.rows.column("_b").take(at)]
        cols += [pa.repeat(rows.column(c)[k], n) for c in extra] + [index.rows.column(c).take(at) for c in extra]
        return pa.table([*cols, *map(pa.array, found[1:])], names=schema.names).cast(schema)

    def shows(rows: pa.Table, k: int, steps: np.ndarray) -> pa.Table:
        at = np.flatnonzero(steps)
        cols = [pa.repeat(rows.column(c)[k], 1) for c in (*scope, "_a")]
        return pa.table([*cols, pa.array([at]), pa.array([steps[at]])], names=schema.names).cast(schema)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table | None]:
        current, held, streams, index = None, [], [], None

        def close() -> Iterator[pa.Table | None]:
            """The block is whole: index it, and let its own streams meet the later ones."""
            nonlocal index, held, streams
            if index is not None or not held:
                return
            index = _Index(streams, pa.concat_tables(held).combine_chunks(), params.seed_max_bucket)
            held, streams = [], []
            if not ordered or current[-1]:
                return
            done = np.zeros(1 << KEY_BITS, np.int64)
            for s, (i, n) in enumerate(zip(index.starts.tolist(), index.sizes.tolist(), strict=True)):
                np.add.at(done, index.living(s), 1)
                yield told(index, index.rows, s, index.items[i : i + n], done)

        def left() -> Iterator[pa.Table]:
            """What the block's streams have been counted."""
            if index is not None:
                for s, steps in index.steps():
                    yield shows(index.rows, s, steps)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            narrow = table.drop_columns(["_items"])
            packed, wide, probes = (table.column(c).to_pylist() for c in ("_items", "_wide", "_probe"))
            keys = list(zip(*(table.column(c).to_pylist() for c in place), strict=True))
            for k, key in enumerate(keys):
                if key != current:
                    yield from close()
                    yield from left()
                    current, held, streams, index = key, [], [], None
                items = np.frombuffer(packed[k], np.uint64 if wide[k] else np.uint32)
                if probes[k]:
                    yield from close()
                    yield told(index, narrow, k, items, None)
                else:
                    if not k or probes[k - 1] or keys[k - 1] != key:
                        held.append(narrow.slice(k))
                    streams.append(items)
                    if k + 1 == len(keys) or keys[k + 1] != key or probes[k + 1]:
                        held[-1] = held[-1].slice(0, held[-1].num_rows - (len(keys) - k - 1))
        yield from close()
        yield from left()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, n = [], 0
        for found in results(batches):
            if found is None:
                continue
            ready.append(found)
            n += len(found)
            if n >= ROWS:
                yield from pa.concat_tables(ready).combine_chunks().to_batches()
                ready, n = [], 0
        if ready:
            yield from pa.concat_tables(ready).combine_chunks().to_batches()

    return met


def _copied(block: Column) -> Column:
    """Copies of a block's size that all blocks before ``block`` take, where streams meet each other."""
    before = F.greatest(block - 1, F.lit(0))
    q = F.floor(before / PROBES)
    return block * (block + 1) / 2 + PROBES * q * (q - 1) / 2 + (before - q * PROBES) * q


def meet(a: DataFrame, b: DataFrame | None, params: DetectParams, scope: Sequence[str], extra: Sequence[str] = (), result: str = "votes") -> DataFrame:
    """(scope, a, b, a_extra, b_extra, off, votes, lo, hi): the strong alignments, those of ``match.votes`` that ``match.candidate_offsets`` ranks.

    Without ``b`` the streams ``a`` meet each other, a being that with the smaller ``idx``. Then the result may be
    "runs", the verified runs (scope, a, b, off, start, end) of the best alignments, or "shows": with how many others
    each stream shares its positions, as steps (scope, file, at, step) that add up to the counts over all its rows. Steps are stored.
    """
    ordered = b is None
    indexed = a if ordered else b
    order = F.col("idx") if ordered else F.xxhash64("file")

    def files(probe: bool) -> list:
        """A stream's name as one of a and as one of b, which may be of different types."""
        absent = lambda df: F.lit(None).cast(df.schema["file"].dataType)
        return [(F.col("file") if x else absent(df)).alias(n) for x, df, n in ((probe or ordered, a, "_a"), (not probe, indexed, "_b"))]

    def side(streams: DataFrame, probe: bool) -> DataFrame:
        known = streams.filter(F.col("file").isNotNull() & order.isNotNull() & (F.size("items") > 0))
        dials = [params.min_items(F.col("item_sec")), params.max_gap_items(F.col("item_sec"))] if result != "votes" else [F.lit(0), F.lit(0)]
        dials = [c.cast("int").alias(n) for c, n in zip((*dials, params.bit_err(F.col("bits"))), ("_least", "_gap", "_err"), strict=True)]
        return known.select(*scope, order.alias("_order"), F.lit(probe).alias("_probe"), *files(probe), *extra, *dials, (F.col("bits") == 64).alias("_wide"), F.col("items"), F.col("bits").alias("_bits"))

    # a block is a stretch of the order; told by its beginnings, which are few
    before = Window.partitionBy(*scope).orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = indexed.filter(order.isNotNull() & (F.size("items") > 0)).select(*scope, order.alias("_order"), F.size("items").cast("long").alias("n"))
    begins = sizes.withColumn("_block", F.floor((F.sum("n").over(before) - 1) / BLOCK)).groupBy(*scope, "_block").agg(F.min("_order").alias("_from"), F.sum("n").alias("_n"))
    begins = begins.groupBy(*scope).agg(F.sort_array(F.collect_set("_from")).alias("_from"), F.sum("_n").alias("_n"))
    begins = materialize(begins, "blocks")  # its size decides how it is joined

    last = F.size("_from") - 1
    home = F.size(F.filter("_from", lambda x: x <= F.col("_order"))) - 1
    told = side(indexed, False).join(begins.drop("_n"), list(scope)).withColumn("_block", home)
    asked = side(a, True).join(begins.drop("_n"), list(scope)).withColumn("_home", home if ordered else F.lit(-1)).filter(last > F.col("_home"))
    asked = asked.withColumn("_block", F.explode(F.sequence(F.col("_home") + 1, last)))
    if ordered:  # a late block has many before it: several tasks index it, and the first its own pairs too
        told = told.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("_block") - 1) / PROBES).cast("int")))))
        asked = asked.withColumn("_part", F.floor(F.col("_home") / PROBES).cast("int"))
    else:
        told, asked = (x.withColumn("_part", F.lit(0)) for x in (told, asked))
    rounds = 1
    if result == "shows":
        copied, n = begins.select((F.col("_n") * _copied(last + 1) / (last + 1)).alias("_c"), "_n").agg(F.sum("_c"), F.sum("_n")).first()
        rounds = max(1, math.ceil((copied or 0) / max(SHARE * (n or 0), ROUND)))
        # a scope's tasks are dealt evenly to the rounds, those of one block by their names
        place = F.floor(rounds * (_copied(F.col("_block")) + F.col("_part") * (PROBES + 1)) / _copied(last + 1))
        turn = F.when(last > 0, place).otherwise(F.pmod(F.xxhash64(*scope), F.lit(rounds)))
        told, asked = (x.withColumn("_round", turn) for x in (told, asked))
    columns = [*scope, "_block", "_part", "_probe", "_order", "_a", "_b", *extra, "_least", "_gap", "_err", "_wide", "items", "_bits"]

    def dealt(which: Column) -> DataFrame:
        both = told.filter(which).select(*columns).union(asked.filter(which).select(*columns)).withColumn("_items", F.arrow_udf(_packed, "binary")("items", "_bits")).drop("items", "_bits")
        return both.repartition(*scope, "_block", "_part").sortWithinPartitions(*scope, "_block", "_part", "_probe", "_order")

    own, theirs = a.schema, indexed.schema
    fields = [StructField(c, own[c].dataType) for c in scope]
    if result == "shows":
        fields += [StructField("file", own["file"].dataType), StructField("at", ArrayType(IntegerType())), StructField("step", ArrayType(IntegerType()))]
    else:
        fields += [StructField("a", own["file"].dataType), StructField("b", theirs["file"].dataType)]
        fields += [*(StructField(f"a_{c}", own[c].dataType) for c in extra), *(StructField(f"b_{c}", theirs[c].dataType) for c in extra)]
        fields += [StructField(c, LongType() if c == "votes" else IntegerType()) for c in (("off", "start", "end") if result == "runs" else ("off", "votes", "lo", "hi"))]
    schema = StructType(fields)
    met = _met(params, scope, extra, ordered, result, to_arrow_schema(schema))
    if result != "shows":
        return dealt(F.lit(True)).mapInArrow(met, schema)
    # what a round shuffles is gone when its results are stored
    return reduce(DataFrame.union, [materialize(dealt(F.col("_round") == k).mapInArrow(met, schema), "round") for k in range(rounds)])
