"""Toxicity by a linear-chain conditional random field over tokens.

Documents are labelled, tokens aren't. Training labels of tokens come from the documents': a
greedy cover picks the words and word beginnings that occur in toxic documents and hardly in
others, each time the one that explains most of the documents still unexplained. The field
then learns hashed features of words and the transitions between labels. Forward-backward
marginals over whole texts give each document's score, through a logistic calibration of
their largest and their sum, and the offsets of tokens more likely toxic than not.

Defined results: a null, empty or blank text has no tokens and the score of the smallest
marginals; repeated documents score alike; where labelled rows of either class are missing,
every score is the share of toxic labels. An empty table gives an empty result. A column
named like the output is replaced; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.crf import Calibration, Chains, ascend, logit
from refrain.llm.labelled import Sample

BUCKETS = 1 << 18
#: Remembered word scores a worker holds at most, and tokens whose chains run together.
CACHE_ENTRIES = 400_000
TOGETHER = 1_000_000
#: Training chains are cut to this length; scoring never cuts.
TRAINING_LENGTH = 400
_TOKEN = re.compile(r"\S+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def normal(word: str) -> str:
    return _EDGES.sub("", word).lower()


def features(word: str) -> list[str]:
    """Of a normalised word: itself and its beginnings."""
    return ["w" + word, *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]


def _hashed(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) % BUCKETS for f in features(word)]


def toxic_features(texts: Iterable[set[str]], labels: list[int], ratio: float = 50.0) -> set[str]:
    """Features that together explain the toxic documents, greedily chosen: each in several toxic ones, two where they are few."""
    least = 3 if sum(labels) >= 300 else 2
    clean: Counter[str] = Counter()
    toxic: dict[str, list[int]] = defaultdict(list)
    for k, (words, y) in enumerate(zip(texts, labels, strict=True)):
        found = {f for w in words if len(w) > 2 for f in features(w)}
        if y:
            for f in found:
                toxic[f].append(k)
        else:
            clean.update(found)
    rest = {f: set(ks) for f, ks in toxic.items() if len(ks) >= least and len(ks) >= ratio * clean[f]}
    chosen: set[str] = set()
    explained: set[int] = set()
    while rest:
        f = max(rest, key=lambda f: (len(rest[f]), len(f), f))
        if len(rest[f]) < least:
            break
        explained = rest.pop(f)
        chosen.add(f)
        rest = {g: left for g, ks in rest.items() if len(left := ks - explained) >= least}
    return chosen


class ToxicityModel(dict):
    """The trained field; as a dict: word as it stands in a text -> item score."""

    def __init__(self, sample: Sample, rounds: int = 40, rate: float = 0.3, penalty: float = 0.02) -> None:
        self.share = sample.share
        self.weights = np.zeros(BUCKETS)
        self.bias = np.full(1, -4.0)
        self.pairs = np.zeros((2, 2))
        self.calibration: Calibration | None = None
        if len(set(sample.labels)) == 2:
            self._fit(sample, rounds, rate, penalty)

    def _fit(self, sample: Sample, rounds: int, rate: float, penalty: float) -> None:
        ids: dict[str, int] = {}
        chains = [np.array([ids.setdefault(normal(w), len(ids)) for w in t.split()], np.int64) for t in sample.texts]
        words = list(ids)
        chosen = toxic_features(({words[k] for k in set(c.tolist())} for c in chains), sample.labels)
        marked = np.array([any(f in chosen for f in features(w)) for w in words], np.int64)
        tokens = np.concatenate(chains)
        labels = np.concatenate([marked[c] * y for c, y in zip(chains, sample.labels, strict=True)])
        lengths = [min(TRAINING_LENGTH, len(c) - s) for c in chains for s in range(0, len(c), TRAINING_LENGTH)]
        layout = Chains(np.array(lengths))
        hashed = [_hashed(w) for w in words]
        owner = np.repeat(np.arange(len(words)), [len(h) for h in hashed])
        bucket = np.concatenate([np.array(h) for h in hashed])

        def gradients() -> list[np.ndarray]:
            score = np.bincount(owner, self.weights[bucket], len(words)) + self.bias[0]
            by_item, by_pair = layout.gradients(score[tokens], labels, self.pairs)
            by_word = np.bincount(tokens, by_item, len(words))
            return [np.bincount(bucket, by_word[owner], BUCKETS) - penalty * self.weights, np.array([by_item.sum()]), by_pair - penalty * self.pairs]

        ascend([self.weights, self.bias, self.pairs], gradients, rounds, rate)
        x = self.aggregates(self.marginals([[self[w] for w in t.split()] for t in sample.texts]))
        self.calibration = Calibration(x, np.array(sample.labels), self.share)
        self.clear()

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        s = self[word] = float(self.weights[_hashed(normal(word))].sum() + self.bias[0])
        return s

    def __reduce__(self):  # noqa: ANN204
        return _rebuilt, (self.__dict__,)

    def marginals(self, scores: list[list[float]]) -> list[np.ndarray]:
        lengths = np.array([len(s) for s in scores])
        flat = np.fromiter((x for s in scores for x in s), float, int(lengths.sum()))
        return np.split(Chains(lengths).marginals(flat, self.pairs), np.cumsum(lengths)[:-1])

    @staticmethod
    def aggregates(marginals: list[np.ndarray]) -> np.ndarray:
        top = np.array([m.max() if len(m) else 0.0 for m in marginals])
        return np.stack([logit(top), np.log1p([m[m > 0.01].sum() for m in marginals])], axis=1)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and (begin, end) of offending tokens in code points; whole texts, some at a time."""
        scores, spans = [], []
        some: list[list[float]] = []
        begin = size = 0
        for k, t in enumerate(texts):
            some.append(list(map(self.__getitem__, (t or "").split())))
            size += len(some[-1])
            if size >= TOGETHER or k == len(texts) - 1:
                found = self.marginals(some)
                scores.append(self.calibration(self.aggregates(found)) if self.calibration else np.full(len(found), self.share))
                spans += [self._spans(texts[begin + i], m) if len(m) and m.max() >= 0.5 else [] for i, m in enumerate(found)]
                some, begin, size = [], k + 1, 0
        return np.concatenate(scores) if scores else np.zeros(0), spans

    @staticmethod
    def _spans(text: str, marginals: np.ndarray) -> list[tuple[int, int]]:
        places = [m.span() for m in _TOKEN.finditer(text)]
        if len(places) != len(marginals):  # split() and \S differ on a few control characters
            places, at = [], 0
            for w in text.split():
                at = text.index(w, at)
                places.append((at, at + len(w)))
                at += len(w)
        return [places[k] for k in np.flatnonzero(marginals >= 0.5)]


def _rebuilt(state: dict) -> ToxicityModel:
    model = ToxicityModel.__new__(ToxicityModel)
    model.__dict__.update(state)
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``df`` with struct ``out``: score, and spans (begin, end) of offending tokens."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("score double, spans array<struct<begin: long, end: long>>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for texts in batches:
            scores, spans = known.score(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], kind)], names=["score", "spans"])

    return df.withColumn(out, scored(F.col(f"`{text}`")))
