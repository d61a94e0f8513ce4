"""A compressed set of token boundaries with select, in containers of 2^16 positions.

Positions that share their high bits lie in one container, which keeps their low 16 bits in the
smallest of three forms: a sorted array, a bitmap, or runs of consecutive positions. The cumulative
cardinalities of the containers answer ``select``: a search in them finds the container of a rank, and
what is left of the rank is selected inside it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

SPAN = 1 << 16
ARRAY, BITMAP, RUN = 0, 1, 2
_BITMAP_WORDS = SPAN // 64
_BITMAP_BYTES = SPAN // 8


@dataclass(frozen=True)
class Container:
    """Low halves of the positions of one span of 2^16."""

    kind: int
    #: array: the low halves; bitmap: 1,024 words of 64 bits, lowest bit first; runs: the first of each run.
    data: np.ndarray
    #: bitmap: positions before each word; runs: positions before each run. Unused in arrays.
    before: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Low halves at the given ranks, each from 0 and below the container's cardinality."""
        if self.kind == ARRAY:
            return self.data[ranks].astype(np.int64)
        at = np.searchsorted(self.before, ranks, "right") - 1
        rest = ranks - self.before[at]
        if self.kind == RUN:
            return self.data[at].astype(np.int64) + rest
        return at * 64 + _select_in_words(self.data[at], rest)


def _select_in_words(words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The bit of each word that has ``rank`` set bits below it, by halving."""
    words, ranks = words.copy(), ranks.astype(np.int64)
    at = np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & np.uint64((1 << width) - 1)).astype(np.int64)
        up = ranks >= low
        ranks = np.where(up, ranks - low, ranks)
        words = np.where(up, words >> np.uint64(width), words)
        at += np.where(up, width, 0)
    return at


def _container(low: np.ndarray) -> Container:
    """The smallest form for sorted distinct low halves; of equal sizes array, bitmap, runs in this order."""
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    sizes = {ARRAY: 2 * len(low), BITMAP: _BITMAP_BYTES, RUN: 4 * len(first)}
    kind = min(sizes, key=lambda k: (sizes[k], k))
    if kind == ARRAY:
        return Container(ARRAY, low.astype(np.uint16))
    if kind == RUN:
        return Container(RUN, low[first].astype(np.uint16), first.astype(np.int64))
    bits = np.zeros(SPAN, np.uint8)
    bits[low] = 1
    words = np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64)
    counts = np.bitwise_count(words).astype(np.int64)
    return Container(BITMAP, words, np.cumsum(counts) - counts)


@dataclass(frozen=True)
class BoundarySet:
    """Containers in ascending order, their high halves, and the positions before each."""

    highs: np.ndarray
    containers: tuple[Container, ...]
    before: np.ndarray  # one longer than containers: the last is the cardinality

    @property
    def cardinality(self) -> int:
        return int(self.before[-1])

    @staticmethod
    def of(positions: np.ndarray) -> BoundarySet:
        """The set of strictly ascending positions from 0 on."""
        positions = np.asarray(positions, np.int64)
        if len(positions) and (positions[0] < 0 or (np.diff(positions) <= 0).any()):
            raise ValueError("positions must ascend strictly from 0 on")
        highs = positions // SPAN
        edges = np.concatenate([np.flatnonzero(np.diff(highs, prepend=-1)), [len(positions)]]).astype(np.int64)
        parts = [_container(positions[a:b] % SPAN) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return BoundarySet(highs[edges[:-1]], tuple(parts), edges)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The positions at these ranks, in any order, each from 0 and below the cardinality."""
        ranks = np.asarray(ranks, np.int64)
        if len(ranks) and (ranks.min() < 0 or ranks.max() >= self.cardinality):
            raise IndexError("rank outside the set")
        which = np.searchsorted(self.before, ranks, "right") - 1
        out = np.empty(len(ranks), np.int64)
        for k in np.unique(which):
            mine = which == k
            out[mine] = self.highs[k] * SPAN + self.containers[k].select(ranks[mine] - self.before[k])
        return out
