"""A linear-chain conditional random field over two labels, for many chains at once.

Scores: one per item for label 1 (label 0 is zero), and one per pair of neighbouring labels.
Forward and backward messages of two labels are ratios, and a step runs over all chains that
are that long, so the chains' lengths and number are free.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Item scores beyond this say no more.
MOST = 20.0


class Chains:
    """The layout of chains of given lengths: step by step, longest chain first."""

    def __init__(self, lengths: np.ndarray) -> None:
        lengths = np.asarray(lengths, np.int64)
        rank = np.empty(len(lengths), np.int64)
        rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
        steps = int(lengths.max()) if len(lengths) else 0
        self.active = np.cumsum(np.bincount(lengths, minlength=steps + 1)[::-1])[::-1][1:] if steps else np.zeros(0, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.active)))
        begin = np.cumsum(lengths) - lengths
        step = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        #: of each item in chain order, its place by step; after it, where its successor is (or -1)
        self.place = self.starts[step] + np.repeat(rank, lengths)
        self.last = step == np.repeat(lengths - 1, lengths)

    def messages(self, scores: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weight, forward, backward) ratios of label 1 to label 0, in chain order."""
        (e00, e01), (e10, e11) = np.exp(pairs).tolist()
        w = np.empty(len(scores))
        w[self.place] = np.exp(np.clip(scores, -MOST, MOST))
        f, b = w.copy(), np.ones(len(w))
        starts, active = self.starts.tolist(), self.active.tolist()
        for t in range(1, len(active)):
            s, c, p = starts[t], active[t], starts[t - 1]
            before = f[p : p + c]
            f[s : s + c] *= (e01 + e11 * before) / (e00 + e10 * before)
        for t in range(len(active) - 2, -1, -1):
            s, n, c = starts[t], starts[t + 1], active[t + 1]
            after = w[n : n + c] * b[n : n + c]
            b[s : s + c] = (e10 + e11 * after) / (e00 + e01 * after)
        return w[self.place], f[self.place], b[self.place]

    def marginals(self, scores: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Each item's probability of label 1."""
        _, f, b = self.messages(scores, pairs)
        odds = f * b
        return odds / (1 + odds)

    def gradients(self, scores: np.ndarray, labels: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of ``labels``: by item score, and by pair."""
        w, f, b = self.messages(scores, pairs)
        odds = f * b
        inner = np.flatnonzero(~self.last)
        ahead = w[inner + 1] * b[inner + 1]
        e = np.exp(pairs)
        joint = np.stack([np.full(len(inner), e[0, 0]), e[0, 1] * ahead, e[1, 0] * f[inner], e[1, 1] * f[inner] * ahead])
        expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        seen = np.bincount(2 * labels[inner] + labels[inner + 1], minlength=4).reshape(2, 2)
        return labels - odds / (1 + odds), seen - expected


def ascend(parameters: list[np.ndarray], gradients: Callable[[], list[np.ndarray]], rounds: int, rate: float) -> None:
    """Adam, in place, over whole-sample gradients."""
    first, second = ([np.zeros_like(p) for p in parameters] for _ in range(2))
    for k in range(1, rounds + 1):
        for p, g, m, v in zip(parameters, gradients(), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)


class Calibration:
    """Logistic regression from a chain's aggregates to the probability of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: float, rounds: int = 25, ridge: float = 1e-3) -> None:
        """share: of label 1 among all labelled rows, to which the sample is weighted. Fitted by damped Newton steps."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) / len(y)
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
            w += np.clip(np.linalg.solve(curve, z.T @ (weight * (y - p)) - ridge * w), -2, 2)
        self.w, self.b = w[:-1], w[-1:]

    def _p(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.w + self.b[0], -30, 30)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._p((x - self.mean) / self.scale)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))
