"""Substring deduplication by seed and extend over winnowed anchors.

A window is ``window`` consecutive words of one document. Each window's anchor is the
smallest hash among its ``seed``-word grams (the leftmost of equals), so equal windows have
equal anchors at equal places; that is winnowing, and one anchor serves some seven windows
in a row. The stretch of words those windows span is the anchor extended both ways as far
as it remains their anchor.

1. Documents meet on anchors. Of equal stretches around an anchor all but the first
   occurrence repeat, whole. Only where one anchor has different stretches can a repeat end
   inside one: those stretches go on to the second step.
2. Their windows are compared one by one by the same means.

The union of repeated windows, each at least ``window`` words long by construction, makes up
the maximal repeats. Nothing is compared pair by pair: occurrences are sorted and each is
held against the first. A task sends one row per distinct stretch, so a passage in a third
of all documents is one row per task; an anchor with many different stretches within a task
sends two, the others go to the second step directly, spread by their windows.

Keys are 128 bits of hash. Defined results: a null text has no words; fewer words than a
window repeat nothing; rows that repeat id and text are one document and share its result;
a row without id counts as before all others; rows that lack an id, or share one, with
different texts are different documents, in the order of a hash of their texts; ids that are
no integers are in the order of a hash. An empty table gives an empty result. Columns named
like an output are replaced, others pass through, whatever their names.

Equal means equal in 128 bits of hash over the words: texts aren't compared again, as a chance
meeting is out of reach (10^13 windows give one in 10^12).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.sources.shared import materialize

#: Fixed odd multipliers of the rolling hashes and the final mix.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Different stretches of one anchor within a task beyond which they skip the first step.
MANY_STRETCHES = 32
#: Remembered word hashes a worker holds at most.
CACHE_ENTRIES = 500_000
_NO_ID = -(2**63)
#: kind: 0 to be compared, 1 repeated, 2 for the second step.
_ROW = pa.schema([("kind", pa.int8()), ("m", pa.int64()), ("h", pa.int64()), ("doc", pa.int64()), ("salt", pa.int64()), ("pos", pa.int32()), ("run", pa.int32())])
ROW_TYPE = "kind tinyint, m long, h long, doc long, salt long, pos int, run int"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def rolling(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of every ``size`` consecutive word hashes, by doubling."""
    out, done, power, step, step_size = None, 0, pow(base, 1, 2**64), words, 1
    while True:
        if size & step_size:
            if out is None:
                out, done = step, step_size
            else:  # what is done, followed by a step
                n = len(words) - done - step_size + 1
                out = out[:n] * np.uint64(pow(base, step_size, 2**64)) + step[done : done + n]
                done += step_size
        if done == size:
            return out
        n = len(words) - 2 * step_size + 1
        step = step[:n] * np.uint64(pow(base, step_size, 2**64)) + step[step_size : step_size + n]
        step_size *= 2


def _leftmost_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each ``width`` consecutive values, the leftmost of equals."""
    pos = np.arange(len(v) - width + 1)
    best = v[: len(pos)].copy()
    for j in range(1, width):
        other = v[j : j + len(pos)]
        less = other < best
        best[less] = other[less]
        pos[less] = np.flatnonzero(less) + j
    return pos


def stretches(hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, stretch hash, first window, windows) of each run of windows with the same anchor."""
    grams = _mixed(rolling(hashes, seed, _BASES[0]))
    whole = rolling(hashes, window, _BASES[1])
    at = _leftmost_minimum(grams, window - seed + 1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    last = np.concatenate((first[1:], [len(at)])) - 1
    # a run has fewer windows than a window has words, so its first and last window hold all its words
    run = last - first + 1
    h = _mixed(_mixed(whole[first]) + np.uint64(3) * whole[last] + run.astype(np.uint64) * np.uint64(_BASES[0]) + (at[first] - first).astype(np.uint64) * np.uint64(_BASES[1]))
    return grams[at[first]].view(np.int64), h.view(np.int64), first, run


def _new(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before it; the first does."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def within_task(m: np.ndarray, h: np.ndarray, doc: np.ndarray, salt: np.ndarray, pos: np.ndarray, many: int) -> np.ndarray:
    """Kinds of a batch's rows: 1 where the batch has an earlier equal, 2 for the surplus of an anchor with many stretches."""
    kind = np.zeros(len(m), np.int8)
    order = np.argsort(m, kind="stable")
    alone = _new(m[order])
    alone &= np.append(alone[1:], True)
    o = order[~alone]
    o = o[np.lexsort((pos[o], salt[o], doc[o], h[o], m[o]))]
    new_m, new_h = _new(m[o]), _new(m[o], h[o])
    if not len(o):
        return kind
    head = np.maximum.accumulate(np.where(new_h, np.arange(len(o)), 0))
    repeated = ~new_h & ((doc[o] != doc[o[head]]) | (salt[o] != salt[o[head]]) | (pos[o] != pos[o[head]]))
    kind[o[repeated]] = 1
    group = np.cumsum(new_m) - 1
    rank = np.cumsum(new_h) - 1
    rank -= rank[new_m][group]
    total = np.bincount(group, weights=new_h)[group]
    kind[o[new_h & (total > many) & (rank >= 2)]] = 2
    return kind


def _merged(doc: np.ndarray, salt: np.ndarray, pos: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining runs of a document as one."""
    o = np.lexsort((pos, salt, doc))
    doc, salt, pos, run = doc[o], salt[o], pos[o], run[o]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (salt[1:] != salt[:-1]) | (pos[1:] > pos[:-1] + run[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return doc, salt, pos, run
    end = np.maximum.reduceat(pos + run, first)
    return doc[first], salt[first], pos[first], end - pos[first]


def _batch(kind, m, h, doc, salt, pos, run) -> pa.RecordBatch:  # noqa: ANN001
    """Rows for the shuffle; repeated ones merged, rows that need no comparison without keys."""
    same = kind == 1
    d1, s1, p1, r1 = _merged(doc[same], salt[same], pos[same], run[same])
    rest = ~same
    zero = np.zeros(len(d1), np.int64)
    cols = [np.concatenate(x) for x in ((np.ones(len(d1), np.int8), kind[rest]), (zero, m[rest]), (zero, h[rest]), (d1, doc[rest]), (s1, salt[rest]), (p1, pos[rest]), (r1, run[rest]))]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, _ROW, strict=True)], schema=_ROW)


def _find_stretches(window: int, seed: int, many: int):  # noqa: ANN202
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            parts = []
            for doc, salt, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                w = (text.as_py() or "").encode().split()
                if len(w) >= window:
                    hashes = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
                    m, h, pos, run = stretches(hashes, window, seed)
                    parts.append((m, h, np.full(len(m), doc), np.full(len(m), salt), pos, run))
            if parts:
                m, h, doc, salt, pos, run = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield _batch(within_task(m, h, doc, salt, pos, many), m, h, doc, salt, pos, run)

    return find


def _find_windows(window: int):  # noqa: ANN202
    """Rows of single windows, for the runs of windows that come with each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            parts = []
            for doc, salt, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                w = text.as_py().encode().split()
                hashes = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
                pos = np.unique(np.concatenate([np.arange(r["pos"], r["pos"] + r["run"]) for r in runs.as_py()]))
                m, h = (_mixed(rolling(hashes, window, b)[pos]).view(np.int64) for b in _BASES)
                parts.append((m, h, np.full(len(pos), doc), np.full(len(pos), salt), pos))
            if parts:
                m, h, doc, salt, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
                run = np.ones(len(m), np.int64)
                yield _batch(within_task(m, h, doc, salt, pos, len(m)), m, h, doc, salt, pos, run)

    return find


def _hold_against_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by m, h, doc, salt, pos: repeated rows (1), and rows of anchors with different stretches (2).

    State between batches is one row and the first row of the current anchor, whatever their number.
    """
    last = first = None  # (m, h, doc, salt, pos) of the current stretch's first row; (doc, salt, pos, run) of an anchor's only stretch so far
    several = False
    for batch in batches:
        kind, m, h, doc, salt, pos, run = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        through = kind != 0
        out = [(kind[through], doc[through], salt[through], pos[through], run[through])]
        m, h, doc, salt, pos, run = (x[~through] for x in (m, h, doc, salt, pos, run))
        if len(m):
            new_m, new_h = _new(m), _new(m, h)
            if last is not None and m[0] == last[0]:
                new_m[0], new_h[0] = False, h[0] != last[1]
            head = np.maximum.accumulate(np.where(new_h, np.arange(len(m)), -1))
            head_doc = np.where(head >= 0, doc[head], last[2] if last else 0)
            head_salt = np.where(head >= 0, salt[head], last[3] if last else 0)
            head_pos = np.where(head >= 0, pos[head], last[4] if last else 0)
            repeated = ~new_h & ((doc != head_doc) | (salt != head_salt) | (pos != head_pos))
            out.append((np.ones(int(repeated.sum()), np.int8), doc[repeated], salt[repeated], pos[repeated], run[repeated]))
            group = np.cumsum(new_m)  # 0: continues the last batch's anchor
            n = np.bincount(group, weights=new_h, minlength=int(group[-1]) + 1)
            if n[0] and first is not None and not several:
                out.append((np.full(1, 2, np.int8), *(np.array([x]) for x in first)))
            multiple = n >= 2
            multiple[0] = n[0] >= 1
            chosen = new_h & multiple[group]
            out.append((np.full(int(chosen.sum()), 2, np.int8), doc[chosen], salt[chosen], pos[chosen], run[chosen]))
            at = int(head[-1])
            if at >= 0:
                last = (m[at], h[at], doc[at], salt[at], pos[at])
            if group[-1] > 0:
                k = int(np.flatnonzero(new_m)[-1])
                first, several = (doc[k], salt[k], pos[k], run[k]), bool(n[-1] >= 2)
            else:
                several = several or bool(n[0])
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["kind", "doc", "salt", "pos", "run"])


def _resolved(rows: DataFrame) -> DataFrame:
    """Rows spread by key (rows that need no comparison by document), sorted, and held against the first of each key."""
    place = F.when(F.col("kind") == 0, F.col("m")).otherwise(F.xxhash64("doc", "salt", "pos"))
    return rows.repartition(place).sortWithinPartitions("m", "h", "doc", "salt", "pos").mapInArrow(_hold_against_first, "kind tinyint, doc long, salt long, pos int, run int")


def _identity(df: DataFrame, id_col: str, text: str) -> tuple[Column, Column]:
    """(doc, salt) of a row: its id, and a hash of its text where the id alone doesn't tell (even; odd without id).

    An id that is no integer stands as a hash of it, and its row is told apart by its text always.
    """
    raw, digest = F.col(f"`{id_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    ident = raw.try_cast("long")
    odd = raw.isNotNull() & ident.isNull()
    by_id = df.select(ident.alias("doc"), digest.alias("h")).filter("doc IS NOT NULL").groupBy("doc").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    shared = bool(by_id.filter("lo <> hi").limit(1).count())
    even = digest.bitwiseAND(F.lit(-2)) if shared else F.when(odd, digest.bitwiseAND(F.lit(-2))).otherwise(F.lit(0).cast("long"))
    doc = F.coalesce(ident, F.when(odd, F.xxhash64(raw.cast("string"))), F.lit(_NO_ID))
    return doc, F.when(raw.isNull(), digest.bitwiseOR(F.lit(1).cast("long"))).otherwise(even)


def repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, seed: int = 8, many: int = MANY_STRETCHES) -> DataFrame:
    """(doc, salt, spans: array of pos, run): each document's runs of windows that also start earlier; see ``_identity``."""
    doc, salt = _identity(df, id_col, text)
    return _repeats(df.select(doc.alias("doc"), salt.alias("salt"), F.col(f"`{text}`").alias("text")), window, seed, many)


def _repeats(docs: DataFrame, window: int, seed: int, many: int) -> DataFrame:
    found = _resolved(docs.mapInArrow(_find_stretches(window, seed, many), ROW_TYPE))
    found = materialize(found, "repeats")
    span = F.struct("pos", "run")
    # runs of one document; it has no more of them than windows
    undecided = found.filter("kind = 2").groupBy("doc", "salt").agg(F.collect_list(span).alias("runs"))
    texts = docs.join(undecided, ["doc", "salt"]).select("doc", "salt", "text", "runs")
    singles = _resolved(texts.mapInArrow(_find_windows(window), ROW_TYPE)).filter("kind = 1").select("doc", "salt", "pos", "run")
    both = found.filter("kind = 1").select("doc", "salt", "pos", "run").union(singles)
    return both.groupBy("doc", "salt").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def _kept(text: Column, spans: Column, window: int) -> Column:
    @F.arrow_udf("n_words long, n_removed long, kept string")
    def kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
        n, gone, left = [], [], []
        for t, s in zip(texts, spans, strict=True):
            w = (t.as_py() or "").encode().split()
            n.append(len(w))
            removed = 0
            if s.is_valid and len(w) >= window:
                out, at = [], 0
                for x in s.as_py():
                    out += w[at : x["pos"]]
                    end = min(x["pos"] + x["run"] + window - 1, len(w))
                    removed += max(0, end - max(at, x["pos"]))
                    at = max(at, end)
                w = out + w[at:]
            gone.append(removed)
            left.append(b" ".join(w).decode())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=["n_words", "n_removed", "kept"])

    return kept(text, spans)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, seed: int = 8, many: int = MANY_STRETCHES) -> DataFrame:
    """``df`` with n_words, n_removed and kept: its words without those of repeats, joined by one blank."""
    doc, salt = _identity(df, id_col, text)
    outputs = ("n_words", "n_removed", "kept")
    own = [c for c in df.columns if c not in outputs]
    docs = df.select(doc.alias("doc"), salt.alias("salt"), F.col(f"`{text}`").alias("text"))
    rows = df.select(doc.alias("doc"), salt.alias("salt"), F.col(f"`{text}`").alias("text"), F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own) if c != text)).alias("row"))
    joined = rows.join(_repeats(docs, window, seed, many), ["doc", "salt"], "left").withColumn("out", _kept(F.col("text"), F.col("spans"), window))
    return joined.select(*((F.col("text") if c == text else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(own)), *(F.col(f"out.{c}").alias(c) for c in outputs))
