"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad; its features are binned measures of itself and of the lines before
and after it. A training line has its document's label. Forward-backward marginals, weighted
by the lines' lengths, and their calibration give the document's score.

Defined results: blank lines don't count; a null or blank text has one empty line; repeated
documents score alike; where labelled rows of either class are missing, every score is the
share of good labels, and ``keep_good`` keeps everything. An empty table gives an empty
result. A column named like the output is replaced by ``score_quality``; other columns,
whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.crf import Calibration, Chains, ascend, logit
from refrain.llm.labelled import Sample

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) and c not in b".,;:'\"-()?")
#: Upper edges of the bins of each measure.
_EDGES = (
    (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),  # upper case, of all bytes
    (0.005, 0.02, 0.05, 0.1, 0.2, 0.35),  # symbols
    (0.01, 0.03, 0.08, 0.15, 0.3, 0.6),  # digits
    (0.2, 0.35, 0.5, 0.65, 0.8, 0.95),  # different words, of all words
    (0.01, 0.05, 0.1, 0.25, 0.5, 0.75),  # words that repeat the one before
    (2.5, 3.5, 4.5, 6.0, 8.0, 12.0),  # mean bytes of a word
    (1.5, 3.5, 8.5, 20.5, 60.5, 200.5),  # words
    (0.02, 0.05, 0.1, 0.2, 0.3, 0.4),  # words of one byte
    (0.5, 1.5, 2.5, 4.5, 8.5, 16.5),  # earlier lines of the document that are the same
)
BINS = max(map(len, _EDGES)) + 1
_EDGE_TABLE = np.array(_EDGES)
#: Lines whose chains run together, and texts that a worker unpacks at once.
TOGETHER = 50_000
SLICE = 1_000


def measures(text: str | None) -> tuple[list[tuple[float, ...]], list[int]]:
    """A tuple per line that isn't blank, and the lines' lengths in bytes."""
    rows, sizes = [], []
    seen: dict[bytes, int] = {}
    for line in (text or "").encode().split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, k = len(line), len(words)
        same = seen.get(line, 0)
        seen[line] = same + 1
        rows.append((
            (n - len(line.translate(None, _UPPER))) / n, (n - len(line.translate(None, _SYMBOL))) / n, (n - len(line.translate(None, _DIGIT))) / n,
            len(set(words)) / k, sum(map(eq, words, words[1:])) / k, (n - k + 1) / k, k, list(map(len, words)).count(1) / k, same,
        ))
        sizes.append(n)
    if not rows:
        return [(0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)], [1]
    return rows, sizes


def columns(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The active weights of each line: a bin per measure of itself, the line before and the line after."""
    bins = (rows[:, :, None] > _EDGE_TABLE[None]).sum(axis=2)
    width = len(_EDGES)
    own = bins + BINS * np.arange(width)
    nothing = 3 * width * BINS
    last = np.cumsum(lengths) - 1
    before, after = np.empty_like(own), np.empty_like(own)
    before[1:] = own[:-1] + width * BINS
    before[last - lengths + 1] = nothing
    after[:-1] = own[1:] + 2 * width * BINS
    after[last] = nothing + 1
    return np.concatenate([own, before, after], axis=1)


WEIGHTS = 3 * len(_EDGES) * BINS + 2


class QualityModel:
    def __init__(self, sample: Sample, rounds: int = 800, rate: float = 0.3, penalty: float = 0.003) -> None:
        self.share = sample.share
        self.weights, self.pairs = np.zeros(WEIGHTS), np.zeros((2, 2))
        self.calibration: Calibration | None = None
        if len(set(sample.labels)) < 2:
            return
        rows, lengths, sizes = self._read(sample.texts)
        labels = np.repeat(np.array(sample.labels), lengths)
        layout, active = Chains(lengths), columns(rows, lengths)

        def gradients() -> list[np.ndarray]:
            by_item, by_pair = layout.gradients(self.weights[active].sum(axis=1), labels, self.pairs)
            return [np.bincount(active.ravel(), np.repeat(by_item, active.shape[1]), WEIGHTS) - penalty * self.weights, by_pair - penalty * self.pairs]

        ascend([self.weights, self.pairs], gradients, rounds, rate)
        self.calibration = Calibration(self._aggregates(rows, lengths, sizes), np.array(sample.labels), self.share)

    @staticmethod
    def _read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [measures(t) for t in texts]
        return np.array([r for rows, _ in found for r in rows]), np.array([len(rows) for rows, _ in found]), np.array([s for _, sizes in found for s in sizes], float)

    def _aggregates(self, rows: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        good = Chains(lengths).marginals(self.weights[columns(rows, lengths)].sum(axis=1), self.pairs)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        return logit(np.bincount(doc, good * sizes) / np.bincount(doc, sizes))[:, None]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts, some at a time."""
        if self.calibration is None:
            return np.full(len(texts), self.share)
        out, some, size = [], [], 0
        for k, t in enumerate(texts):
            some.append(t)
            size += (t or "").count("\n") + 1
            if size >= TOGETHER or k == len(texts) - 1:
                out.append(self.calibration(self._aggregates(*self._read(some))))
                some, size = [], 0
        return np.concatenate(out) if out else np.zeros(0)


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", out: str = "quality") -> DataFrame:
    """``df`` with column ``out``: the probability that a document is of good quality."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for texts in batches:
            parts = (texts.slice(k, SLICE).to_pylist() for k in range(0, len(texts), SLICE))
            yield pa.array([s for part in parts for s in known.score(part).tolist()], pa.float64())

    return df.withColumn(out, scored(F.col(f"`{text}`")))


def keep_good(df: DataFrame, model: QualityModel, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``df`` that score at least ``threshold``, with their own columns only."""
    if model.calibration is None:
        return df
    rows = df.select(F.col(f"`{text}`").alias("text"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    return score_quality(rows, model, out="score").filter(F.col("score") >= threshold).select("row.*")
