"""Token counts by heap-and-linked-list byte-pair merging.

A text's token count under a byte-pair vocabulary is its number of initial symbols minus
the number of merges. Merges never cross a chunk that starts at a word mark, so chunks are
counted once each and remembered; no identifiers are produced.

Defined results: a null or empty text has 0 tokens; a text of any length is counted whole;
repeated rows are counted alike; an empty table gives an empty result; columns named like an
output are replaced, others pass through untouched.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Remembered chunks a worker holds at most (some 150 bytes each), and the longest of them.
CACHE_ENTRIES = 1_000_000
CACHE_CHARS = 64


class PieceCounter(dict):
    """Counts the tokens a sentencepiece BPE model gives; as a dict: chunk key -> count.

    A key that starts with a line feed stands for itself, any other for MARK + key.
    """

    def __init__(self, model_path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        sp = SentencePieceProcessor(model_file=model_path)
        spec = proto.ModelProto.FromString(sp.serialized_model_proto())
        norm, kinds = spec.normalizer_spec, proto.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        normal = [p for p in spec.pieces if p.type == kinds.NORMAL]
        order = sorted(range(len(normal)), key=lambda i: -normal[i].score)
        self.rank = {normal[i].piece: r for r, i in enumerate(order)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.rank):
            raise ValueError("pieces cross word marks or line feeds")
        self._plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        self._normalize = sp.normalize
        self._chunks = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self._plain and MARK not in text:
            keys = text.replace("\n", " \n").split(" ")
            if "" not in keys:
                return sum(map(self.__getitem__, keys))
            normal = MARK + text.replace(" ", MARK)
        else:
            normal = MARK + text.replace(" ", MARK) if self._plain else self._normalize(text)
        return sum(self._of_chunk(c) for c in self._chunks.findall(normal))

    def _of_chunk(self, chunk: str) -> int:
        if chunk[0] == MARK and chunk[1:2] not in ("", MARK, "\n"):
            return self[chunk[1:]]
        return self.merge(chunk)

    def __missing__(self, key: str) -> int:
        n = self.merge(key if key[0] == "\n" else MARK + key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = n
        return n

    def merge(self, chunk: str) -> int:
        """Tokens of one chunk: pop the lowest-ranked adjacent pair (leftmost first) until none is left."""
        rank, parts = self.rank, list(chunk)
        n = len(parts)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = parts[i] + parts[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != len(pair) or parts[i] + parts[j] != pair:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = pair, None
            merges += 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                after = pair + parts[k]
                if after in rank:
                    heapq.heappush(heap, (rank[after], i, after))
            h = left[i]
            if h >= 0:
                before = parts[h] + pair
                if before in rank:
                    heapq.heappush(heap, (rank[before], h, before))
        # a symbol outside the vocabulary falls back to its bytes
        return n - merges + sum(len(p.encode()) - 1 for p in parts if p is not None and p not in rank)


def token_count(text: Column, model_path: str) -> Column:
    """A column: tokens of ``text`` under the model (null: 0), without begin, end or added specials."""

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PieceCounter(model_path)
        for texts in batches:
            yield pa.array([counter.count(t.as_py() or "") for t in texts], pa.int64())

    return counted(text)


def count_tokens(df: DataFrame, model_path: str, text: str = "text", limit: int = 4096, out: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """``df`` with its text's UTF-8 bytes, tokens, and whether the tokens exceed ``limit``.

    Columns of ``df`` that bear one of the names in ``out`` are replaced.
    """
    n_bytes, n_tokens, over = out
    text_col = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    made = df.withColumns({n_tokens: token_count(text_col, model_path), n_bytes: F.octet_length(text_col).cast("long")})
    return made.withColumn(over, F.col(f"`{n_tokens}`") > limit)
