"""Variational inference of topic mixtures, a block of texts at a time.

The same steps as those of Spark's online LDA for one text (Hoffman, Blei and Bach, 2010), with texts side by side in arrays
whose last axis is the text, so that numpy's loops run over many texts instead of one text's few topics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words times texts in a block, or one text; with six topics its weights take 0.8 MB.
BLOCK_CELLS = 1 << 14
#: A text is settled once its mixture's parameters move by no more than this on average, as in Spark.
TOLERANCE = 1e-3
#: exp(digamma(y + 1/2)) / y as a series in 1 / y^2, from the smallest term.
SERIES = (-5509121 / 1393459200, 10313 / 2903040, -37 / 5760, 1 / 24)


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """Exponential of the derivative of log gamma, for positive numbers: the asymptotic series eight steps up, and the steps down."""
    u = x + 7
    u *= x
    p, q = u + 12, u + 16
    p *= u
    q *= u
    q += 60
    down = u + 6
    down *= q
    u += 8
    u *= p
    down += u
    p *= q
    down /= p
    y = x + 3.5
    p = y * -4
    down *= p
    np.exp(down, out=down)
    y += 4
    np.multiply(y, y, out=p)
    np.divide(1, p, out=p)
    series = p * SERIES[0]
    for c in SERIES[1:]:
        series += c
        series *= p
    series += 1
    series *= y
    series *= down
    return series


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma, for positive numbers: ten steps up, taken in pairs, then the asymptotic series."""
    u = x * (x + 9)
    steps = (2 * x + 9) * (1 / u + 1 / (u + 8) + 1 / (u + 14) + 1 / (u + 18) + 1 / (u + 20))
    y = x + 10
    f = 1 / (y * y)
    return np.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240))) - steps


def trigamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ``digamma``."""
    x = np.asarray(x, float)
    steps = sum(1 / (x + i) ** 2 for i in range(10))
    y = x + 10
    f = 1 / (y * y)
    return 1 / y + 0.5 * f + f / y * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f * (1 / 30 - f * 5 / 66)))) + steps


def log_expectation(parameters: np.ndarray) -> np.ndarray:
    """Expected logarithm of each Dirichlet variable; parameters along the last axis."""
    return digamma(parameters) - digamma(parameters.sum(-1, keepdims=True))


class Statistics:
    """What one partition's texts tell of the topics' words and of the mixtures.

    ``weights`` are the exponentials of the topics' expected log weights (topics, vocabulary), ``start`` is what
    every text's mixture starts with.
    """

    def __init__(self, weights: np.ndarray, alpha: np.ndarray, start: np.ndarray):
        self.weights, self.alpha, self.start = weights, alpha, start
        self.words = np.zeros_like(weights)
        self.mixtures = np.zeros(len(alpha))
        self.texts = 0

    def add(self, slots: np.ndarray, counts: np.ndarray, begins: np.ndarray, ends: np.ndarray, times: np.ndarray) -> None:
        """Add texts: words ``begins[i]`` up to ``ends[i]`` are those of text ``i``, which is taken ``times[i]`` times."""
        for rows, words, slot, count, gamma in self._settled(slots, counts, begins, ends - begins):
            log_theta = log_expectation(gamma.T).T
            theta = np.exp(log_theta)
            ratio = self._ratio(words, count, theta)
            ratio *= times[rows]
            for topic, expected in zip(self.words, theta, strict=True):
                topic += np.bincount(slot.ravel(), (expected * ratio).ravel(), len(topic))
            self.mixtures += log_theta @ times[rows]
            self.texts += int(times[rows].sum())

    @staticmethod
    def _ratio(words: np.ndarray, count: np.ndarray, theta: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Each word's count over its weight in the text (words, texts)."""
        out = np.einsum("knb,kb->nb", words, theta, out=out)
        out += 1e-100
        return np.divide(count, out, out=out)

    def _settled(self, slots: np.ndarray, counts: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Groups of texts with words: their positions, the topics' weights of their words (topics, words, texts), these words' slots
        and counts (words, texts), and the parameters of their mixtures (topics, texts).

        Every text goes on until it is settled by itself. When a third of a block is, the next texts take their place.
        """
        queue = np.argsort(-sizes, kind="stable")[:np.count_nonzero(sizes)]
        wide, narrow = self._begun(queue[:0], int(sizes.max(initial=0)), slots, counts, begins, sizes)
        result = narrow[0]
        live = np.zeros(0, bool)
        while True:
            if 3 * np.count_nonzero(live) <= 2 * live.size:
                gone, left = np.flatnonzero(~live), np.flatnonzero(live)
                if gone.size:
                    yield narrow[-1][gone], *(a.take(gone, -1) for a in (*wide[:3], result))
                kept = narrow[-1][left]
                n = int(sizes[np.concatenate((kept, queue[:1]))].max(initial=0))
                if not n:
                    return
                more, queue = np.split(queue, [max(0 if kept.size else 1, BLOCK_CELLS // n - kept.size)])
                new_wide, new_narrow = self._begun(more, n, slots, counts, begins, sizes)
                wide = [np.concatenate((a[..., :n, :].take(left, -1), b), -1) for a, b in zip(wide, new_wide, strict=True)]
                narrow = [np.concatenate((a.take(left, -1), b), -1) for a, b in zip(narrow, new_narrow, strict=True)]
                result = np.empty_like(narrow[0])
                live = np.ones(narrow[-1].size, bool)
            (words, _, count, ratio), (gamma, theta, scale, _) = wide, narrow
            last = gamma
            gamma = theta * np.einsum("knb,nb->kb", words, ratio)
            gamma += self.alpha[:, None]
            theta = exp_digamma(gamma)
            theta *= scale
            self._ratio(words, count, theta, ratio)
            narrow[:2] = gamma, theta
            last -= gamma
            settled = live & ~(np.abs(last, out=last).sum(0) > TOLERANCE * len(gamma))
            if settled.any():
                np.copyto(result, gamma, where=settled)
                live &= ~settled

    def _begun(self, rows: np.ndarray, n: int, slots: np.ndarray, counts: np.ndarray, begins: np.ndarray, sizes: np.ndarray
               ) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Texts of up to ``n`` words before their first step: arrays with a row for each word, and those without."""
        place = np.arange(n)[:, None]
        held = place < sizes[rows]
        place = np.where(held, begins[rows] + place, 0)
        slot, count = slots.take(place), counts.take(place)
        count *= held
        words = self.weights.take(slot, axis=1)
        gamma = np.repeat(self.start[:, None], rows.size, axis=1)
        theta = np.repeat(np.exp(log_expectation(self.start))[:, None], rows.size, axis=1)
        scale = np.exp(-digamma(count.sum(0) + self.alpha.sum()))  # a mixture's parameters add up to this from the first step on
        return [words, slot, count, self._ratio(words, count, theta)], [gamma, theta, scale, rows]
