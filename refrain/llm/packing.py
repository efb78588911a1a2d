"""Sequence packing: first-fit decreasing over a tournament tree, in randomised groups of documents.

Documents are dealt to groups by a hash of id and text. Within a group each document's ids are
cut into whole sequences and a remainder; remainders go, largest first, into the first
sequence that has room, which a tournament tree of free capacities finds in O(log n).
Sequences that stay emptiest are then cut up to fill the gaps of the others.

A group is read as a sorted stream, and packed in lots of at most ``group_docs`` documents
and ``group_bytes`` bytes of text (or a single longer document), so a task's memory has a bound
whatever falls into one group.

Defined results: a null text is empty; every document ends with id ``end_id``, so even an
empty one is a piece of one id; repeated rows are packed once each; remainders of equal size
go in the order of id (null first) and text, so the same rows are packed alike however they
arrive. Rows without id are dealt by where they stand in the input, as any number of them
must spread; only there the packing depends on it. An empty table gives an empty result. Only
the id and text columns are read, whatever else the table holds.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE vocabularies of this kind cut texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers before the older half is forgotten (some 200 bytes each).
CACHE_ENTRIES = 200_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next code from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in printable else next(spare)) for b in range(256)}


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """A byte-level vocabulary's tokens as bytes with their ids, if ids are in the order of the merges; else None."""
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab.get(m.replace(" ", "", 1) if isinstance(m, str) else m[0] + m[1]) for m in merges]
    if None in made or any(x >= y for x, y in zip(made, made[1:], strict=False)):
        return None
    back = {c: b for b, c in byte_alphabet().items()}
    special = {t["content"] for t in spec.get("added_tokens", ())}
    return {bytes(back[c] for c in token): n for token, n in vocab.items() if token not in special}


class TokenIds(dict):
    """Ids of the tokenizers library as little-endian uint32 bytes; as a dict: blank-separated word -> bytes.

    Words are looked up one by one; a new word is merged by its byte ranks where the
    vocabulary's ids are in the order of its merges, which gives the same ids at a fraction of
    the time. Wherever word boundaries could matter (unusual white space, special strings,
    another kind of tokenizer) the library gets the whole text.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.specials = [t["content"] for t in spec.get("added_tokens", ())]
        by_word = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None and spec["model"]["type"] == "BPE"
        ranks = byte_ranks(spec) if by_word else None
        self.merge = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.replace("\n", " \n").split(" ")
        plain = self.merge is not None and "" not in words and "\n\n" not in text and not any(s in text for s in self.specials)
        if plain and sum(map(len, text.split())) == len(text) - text.count(" ") - text.count("\n"):
            first = words[0]
            words[0] = words[0] and "\n"  # any key; replaced below
            out = list(map(self.__getitem__, words))
            out[0] = self.cut(first)
            return b"".join(out)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.cut(word if word[0] == "\n" else " " + word)
        if len(self) >= CACHE_ENTRIES:  # words in use come back from the older half
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def cut(self, chunk: str) -> bytes:
        ids = self.merge(chunk)
        return struct.pack(f"<{len(ids)}I", *ids)


class TournamentTree:
    """Free capacities of up to ``n`` bins; each inner node holds the larger of its two."""

    def __init__(self, n: int, capacity: int) -> None:
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take ``size`` from the first bin that has it, and return that bin."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        tree[i] -= size
        bin_ = i - self.leaves
        i //= 2
        while i:
            best = tree[2 * i] if tree[2 * i] >= tree[2 * i + 1] else tree[2 * i + 1]
            if tree[i] == best:
                break
            tree[i] = best
            i //= 2
        return bin_


def pack_lengths(lengths: list[int], capacity: int, least_cut: int = 1) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of a group of documents.

    Gaps of at least ``least_cut`` are filled from the emptiest sequences.
    """
    pieces: list[tuple[int, int, int]] = []  # of whole sequences
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole = n // capacity * capacity
        pieces.extend((d, s, capacity) for s in range(0, whole, capacity))
        if n > whole:
            rest.append((d, whole, n - whole))
    out = [(d, s, k, q, 0) for q, (d, s, k) in enumerate(pieces)]
    if not rest:
        return out
    rest.sort(key=lambda x: -x[2])  # stable: of equals the earlier document first
    tree = TournamentTree(len(rest), capacity)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for x in rest:
        bins.setdefault(tree.place(x[2]), []).append(x)
    packed = sorted(([sum(x[2] for x in b), b] for b in bins.values()), key=lambda x: -x[0])
    lo, hi = 0, len(packed) - 1
    while lo < hi:  # the emptiest sequence is cut up for the fullest ones' gaps
        gap = capacity - packed[lo][0]
        if gap < least_cut:
            lo += 1
            continue
        fill, last = packed[hi]
        d, s, k = last.pop()
        take = min(gap, k)
        packed[lo][1].append((d, s, take))
        packed[lo][0] += take
        packed[hi][0] -= take
        if take < k:
            last.append((d, s + take, k - take))
        if not last:
            packed.pop()
            hi -= 1
        if packed[lo][0] == capacity:
            lo += 1
    for q, (_, b) in enumerate(packed, len(pieces)):
        at = 0
        for d, s, k in b:
            out.append((d, s, k, q, at))
            at += k
    return out


def pack(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 0, group_docs: int = 2048, least_cut: int = 1, group_bytes: int = 16_000_000
) -> DataFrame:
    """Pieces of sequences: id_col, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    One shuffle brings a group's texts together; they are tokenised there, so that ids never
    travel. Groups hold some ``group_docs`` documents whatever the size of the table, and
    sequence ids are a group's number and the sequence's number in it.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    groups = max(1, math.ceil(docs.count() / group_docs))
    place = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    keyed = docs.withColumn("_tie", F.xxhash64("text")).withColumn("_group", F.pmod(F.xxhash64(F.lit(1), "id", "_tie", place), F.lit(groups)))
    kind = docs.schema["id"].dataType.simpleString()
    names = ("id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")

    def packed(rows: list[tuple[pa.Scalar, bytes]], group: int, used: int) -> tuple[pa.RecordBatch, int]:
        """The pieces of a lot, and how many sequences of its group are used up after it."""
        lengths = np.array([len(x) // 4 for _, x in rows], "int64")
        found = pack_lengths(lengths.tolist(), capacity, least_cut)
        doc, start, length, sequence, offset = (np.array(x, "int64") for x in zip(*found, strict=True))
        batch = pa.RecordBatch.from_arrays([
            pa.array([k.as_py() for k, _ in rows], rows[0][0].type).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(lengths[doc]), pa.array(sequence + (group << 32) + used), pa.array(offset),
            pa.array([rows[d][1][4 * s : 4 * (s + k)] for d, s, k, _, _ in found], pa.binary()),
        ], names=list(names))
        return batch, used + int(sequence.max()) + 1

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        lot: list[tuple[pa.Scalar, bytes]] = []
        size = used = 0
        current = -1
        for batch in batches:
            for ident, body, group in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                t = body.as_py()
                if lot and (group != current or len(lot) >= 2 * group_docs or size + len(t) > group_bytes):
                    out, used = packed(lot, current, used)
                    yield out
                    lot, size = [], 0
                if group != current:
                    current, used = group, 0
                lot.append((ident, encoder.encode(t) + end))
                size += len(t)
        if lot:
            yield packed(lot, current, used)[0]
        pa.default_memory_pool().release_unused()

    dealt = keyed.repartition("_group").sortWithinPartitions("_group", "id", "_tie").select("id", "text", "_group")
    out = dealt.mapInArrow(stream, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("id", id_col)


_encoders: dict[str, TokenIds] = {}


def _encoder(path: str) -> TokenIds:
    """A worker's encoder: what it has remembered serves the next group too."""
    if path not in _encoders:
        _encoders[path] = TokenIds(path)
    return _encoders[path]
