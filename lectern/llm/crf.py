"""A linear-chain conditional random field on hashed features, in numpy.

Trained with partial labels: a position whose label is unknown is summed over,
so pages need only be labelled where a labeller is sure.  Decoded by Viterbi.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np

DIM = 1 << 15


def bucket(name: str) -> int:
    """A feature's place among the DIM weights."""
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIM


class Chain:
    """labels: their names; weights: DIM x labels; step: label x next label; begin: label."""

    def __init__(self, labels: Sequence[str], weights: np.ndarray | None = None, step: np.ndarray | None = None, begin: np.ndarray | None = None) -> None:
        k = len(labels)
        self.labels = list(labels)
        self.weights = np.zeros((DIM, k)) if weights is None else weights
        self.step = np.zeros((k, k)) if step is None else step
        self.begin = np.zeros(k) if begin is None else begin

    def __reduce__(self):
        # half the bytes where the model travels with a task
        return Chain, (self.labels, self.weights.astype(np.float32), self.step, self.begin)

    def train(self, pages: list[list[tuple[list[int], int]]], rounds: int = 60, rate: float = 0.15, penalty: float = 0.02) -> Chain:
        """pages: per position its features and its label (-1 where unknown).  Adam on the penalised likelihood of what is labelled."""
        pages = [p for p in pages if any(y >= 0 for _, y in p)]
        if not pages:
            return self
        k, n = len(self.labels), len(pages)
        pages = sorted(pages, key=len, reverse=True)
        layout = _Layout([*map(len, pages)])
        # positions step by step over all pages, so that nothing is computed for pages that have ended
        order = [pages[i][t] for t, count in enumerate(layout.counts) for i in range(count)]
        features = np.concatenate([np.array(f, np.int64) for f, _ in order])
        of = np.repeat(np.arange(len(order)), [len(f) for f, _ in order])
        known = np.array([y for _, y in order])
        allowed = (known[:, None] < 0) | (known[:, None] == np.arange(k))
        used, local = np.unique(features, return_inverse=True)
        params = [self.weights[used].astype(float), self.step.astype(float), self.begin.astype(float)]
        first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
        for r in range(1, rounds + 1):
            w, step, begin = params
            score = np.stack([np.bincount(of, w[local, y], len(order)) for y in range(k)], 1)
            whole, pairs, starts = _expected(score, step, begin, layout)
            part, part_pairs, part_starts = _expected(np.where(allowed, score, -1e9), step, begin, layout)
            gap = part - whole
            grad = [np.stack([np.bincount(local, gap[of, y], len(used)) for y in range(k)], 1) - penalty * w, part_pairs - pairs - penalty * step, part_starts - starts - penalty * begin]
            for i, g in enumerate(grad):
                g /= n
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                params[i] = params[i] + rate * (first[i] / (1 - 0.9**r)) / (np.sqrt(second[i] / (1 - 0.99**r)) + 1e-8)
        self.weights = np.zeros((DIM, k))
        self.weights[used], self.step, self.begin = params
        return self

    def decode(self, scores: list[Sequence[float]]) -> list[int]:
        """The best labels of one page by Viterbi, from the emission scores of its positions."""
        if not scores:
            return []
        k, step = range(len(self.labels)), self._step
        if len(self.labels) == 2:
            return self._decode_two(scores)
        best = [b + s for b, s in zip(self._begin, scores[0], strict=True)]
        back = []
        for s in scores[1:]:
            now, came = [], []
            for y in k:
                x = max(k, key=lambda x: best[x] + step[x][y])
                now.append(best[x] + step[x][y] + s[y])
                came.append(x)
            best = now
            back.append(came)
        y = max(k, key=best.__getitem__)
        out = [y]
        for came in reversed(back):
            y = came[y]
            out.append(y)
        return out[::-1]

    def _decode_two(self, scores: list[Sequence[float]]) -> list[int]:
        """Viterbi for two labels, on what the second is ahead of the first."""
        (aa, ab), (ba, bb) = self._step
        ahead = self._begin[1] - self._begin[0] + scores[0][1] - scores[0][0]
        back = []
        for s in scores[1:]:
            # into label 0, and into label 1: which label to come from
            to0, to1 = ahead + ba > aa, ahead + bb > ab
            back.append((to0, to1))
            ahead = (ahead + bb if to1 else ab) - (ahead + ba if to0 else aa) + s[1] - s[0]
        y = int(ahead > 0)
        out = [y]
        for came in reversed(back):
            y = int(came[y])
            out.append(y)
        return out[::-1]

    @property
    def _step(self) -> list[list[float]]:
        if "_steps" not in self.__dict__:
            self.__dict__["_steps"] = self.step.tolist()
        return self.__dict__["_steps"]

    @property
    def _begin(self) -> list[float]:
        if "_begins" not in self.__dict__:
            self.__dict__["_begins"] = self.begin.tolist()
        return self.__dict__["_begins"]

    def emission(self, features: list[int]) -> list[float]:
        return self.weights[features].sum(0).tolist()


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class _Layout:
    """Where the positions of pages of these lengths (longest first) lie, step by step: of step t, ``counts[t]`` from ``starts[t]`` on."""

    def __init__(self, lengths: list[int]) -> None:
        n = np.array(lengths)
        self.counts = [int((n > t).sum()) for t in range(lengths[0])]
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).tolist()
        starts = np.array(self.starts)
        self.page = np.concatenate([np.arange(c) for c in self.counts])
        self.last = starts[n - 1] + np.arange(len(n))
        self.now = np.arange(self.counts[0], self.starts[-1])
        self.before = starts[np.repeat(np.arange(len(self.counts)), self.counts)[self.now] - 1] + self.page[self.now]


def _expected(score: np.ndarray, step: np.ndarray, begin: np.ndarray, at: _Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected labels, pairs of labels and first labels, of all pages at once."""
    n, starts, counts = at.counts[0], at.starts, at.counts
    ahead, behind = np.empty_like(score), np.zeros_like(score)
    ahead[:n] = begin + score[:n]
    for t in range(1, len(counts)):
        a, b, c = starts[t - 1], starts[t], counts[t]
        ahead[b : b + c] = _sum(ahead[a : a + c, :, None] + step[None], 1) + score[b : b + c]
    for t in range(len(counts) - 2, -1, -1):
        a, b, c = starts[t], starts[t + 1], counts[t + 1]
        behind[a : a + c] = _sum(step[None] + (score[b : b + c] + behind[b : b + c])[:, None, :], 2)
    total = _sum(ahead[at.last], 1)[at.page]
    each = np.exp(ahead + behind - total[:, None])
    pairs = np.exp(ahead[at.before][:, :, None] + step[None] + (score + behind)[at.now][:, None, :] - total[at.now][:, None, None]).sum(0)
    return each, pairs, each[:n].sum(0)
