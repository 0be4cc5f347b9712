"""Hashed features of whole texts and linear models over them, for the text classifiers.

Features are numbers below ``1 << bits``: each distinct word, each distinct start of a longer word, and one
number for the bin that each statistic of the text falls into. Models are trained on the driver over a bounded,
documented sample of rows, and applied to every row with the weights broadcast (8 << bits bytes).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textblocks import ALNUM, SPACED, Block, distinct_sets, mix, span_hashes, words

STATS = 8
#: Characters that count as symbols
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_BANG = np.zeros(256, dtype=bool)
_BANG[[ord(c) for c in "!?"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
PREFIX = 5


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[at[1:]] - total[at[:-1]]).astype(np.float64)


def _bin(x: np.ndarray, steps: float) -> np.ndarray:
    """Bins of a share in [0, 1], finer near zero."""
    return np.floor(np.sqrt(np.clip(x, 0, 1)) * steps).astype(np.int64)


def extract(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each document (distinct, sorted) and bounds; a text without words has its bins only."""
    w = words(block, ALNUM)
    whole = span_hashes(block.data, w.start, w.end, fold=True)
    head = np.minimum(w.start + PREFIX, w.end)
    start = span_hashes(block.data, w.start, head, fold=True)
    longer = head < w.end
    counts = w.counts
    of = np.repeat(np.arange(block.n), counts)
    spaced = words(block, SPACED).counts
    size = np.maximum(np.diff(block.at), 1)
    unique = np.diff(distinct_sets(whole, w.doc)[1])
    bins = [
        _bin(_sums(_SYMBOL[block.data], block.at) / size, 10),
        _bin(_sums(_UPPER[block.data], block.at) / size, 10),
        _bin(_sums(_BANG[block.data], block.at) / size, 10),
        _bin(_sums(_DIGIT[block.data], block.at) / size, 10),
        _bin(unique / np.maximum(counts, 1), 12),
        _bin(_sums(block.data == 10, block.at) / np.maximum(spaced, 1), 12),
        np.minimum(np.log2(spaced + 1.0), 15).astype(np.int64),
        np.minimum(size / np.maximum(spaced, 1), 31).astype(np.int64) // 2,
    ]
    stats = np.stack([mix(b.astype(np.uint64) + np.uint64((k + 1) << 32)) for k, b in enumerate(bins)], axis=1)
    values = np.concatenate([whole, mix(start[longer] + np.uint64(1)), stats.reshape(-1)])
    owner = np.concatenate([of, of[longer], np.repeat(np.arange(block.n), len(bins))])
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(block.n + 1))
    numbers, at = distinct_sets(values[order] >> np.uint64(64 - bits), bounds)
    return numbers.astype(np.int64), at


def dot(numbers: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights summed over each document's features."""
    total = np.concatenate([[0.0], np.cumsum(weights[numbers])])
    return total[at[1:]] - total[at[:-1]]


@dataclass
class Sample:
    """Training rows as features and bounds."""

    numbers: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(rows: list[np.ndarray]) -> Sample:
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return Sample(np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64), at)

    def gradient(self, per_row: np.ndarray, bits: int) -> np.ndarray:
        sizes = np.diff(self.at)
        return np.bincount(self.numbers, weights=np.repeat(per_row, sizes), minlength=1 << bits)


class Adam:
    def __init__(self, n: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, x: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient**2 - self.v)
        x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(sample: Sample, target: np.ndarray, weight: np.ndarray, bits: int, l2: float = 1e-6, steps: int = 120, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on soft targets in [0, 1]."""
    x = np.zeros((1 << bits) + 1)
    weight = weight / max(weight.sum(), 1e-12)
    adam = Adam(len(x), rate)
    for _ in range(steps):
        off = (sigmoid(dot(sample.numbers, sample.at, x[:-1]) + x[-1]) - target) * weight
        adam.step(x, np.append(sample.gradient(off, bits) + l2 * x[:-1], off.sum()))
    return x[:-1], float(x[-1])


def telling(sample: Sample, target: np.ndarray, bits: int, least: float = 3.0, support: int = 4) -> np.ndarray:
    """Features whose rows' mean target is at least ``least`` standard errors off the sample's mean."""
    sizes = np.diff(sample.at)
    n = np.bincount(sample.numbers, minlength=1 << bits).astype(np.float64)
    hit = np.bincount(sample.numbers, weights=np.repeat(target, sizes), minlength=1 << bits)
    mean = target.mean() if len(target) else 0.0
    z = (hit - n * mean) / np.sqrt(np.maximum(n * mean * (1 - mean), 1e-9))
    return (n >= support) & (np.abs(z) >= least)


def restrict(sample: Sample, keep: np.ndarray) -> Sample:
    """The sample with kept features only."""
    on = keep[sample.numbers]
    total = np.concatenate([[0], np.cumsum(on)])
    return Sample(sample.numbers[on], total[sample.at])
