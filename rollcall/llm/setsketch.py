"""SetSketch registers of a set: mergeable, locality-sensitive, with a joint estimate.

Register i keeps the least of independent exponential variables, one per element, on a
logarithmic scale: ``floor(1 - log_b(least))``, truncated to [0, Q + 1].  A larger set has larger
registers, the union of two sets has the greater of their registers, and two sets share a
register with a probability close to their Jaccard similarity (Ertl, 2021).
"""

from __future__ import annotations

import numpy as np

BASE = 1.02
RATE = 20.0
Q = (1 << 16) - 2
CHUNK = 4096


class SetSketch:
    def __init__(self, registers: int = 256, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.size = registers
        self.factors = draw.integers(0, 1 << 63, registers, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = draw.integers(0, 1 << 63, registers, np.uint64)

    def registers(self, elements: np.ndarray) -> np.ndarray:
        """Of a set of 64-bit hashes; all 0 for an empty set."""
        if not len(elements):
            return np.zeros(self.size, np.uint16)
        least = np.full(self.size, np.iinfo(np.uint64).max, np.uint64)
        step = max(64, CHUNK * 16 // self.size)
        for at in range(0, len(elements), step):
            part = elements[at : at + step]
            each = self.factors[:, None] * part[None, :]
            each += self.shifts[:, None]
            np.minimum(least, each.min(axis=1), out=least)
        share = (least.astype(np.float64) + 1.0) / 2.0**64
        level = np.floor(1.0 - np.log(-np.log1p(-np.minimum(share, 1 - 2**-53)) / RATE) / np.log(BASE))
        return np.clip(level, 0, Q + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def _ahead(x: np.ndarray) -> np.ndarray:
    """The chance that one of two registers is greater when its set alone holds share x."""
    return -np.log1p(-np.clip(x, 0, 1 - 1e-12) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(more: np.ndarray, less: np.ndarray, same: np.ndarray, share: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of similarity ``j``, given how many registers of the first set are greater, less and
    equal, and the first set's share of the two sizes."""
    first = np.maximum(_ahead(share - (1 - share) * j), 1e-12)
    second = np.maximum(_ahead((1 - share) - share * j), 1e-12)
    equal = np.maximum(1 - first - second, 1e-12)
    return more * np.log(first) + less * np.log(second) + same * np.log(equal)


GRID = np.linspace(0.02, 1.0, 50)


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float, doubt: float) -> np.ndarray:
    """Whether the similarity of each pair of registers may be ``least`` or more: the best
    likelihood there is within a factor of exp(doubt) of the best anywhere.

    Sizes further apart than ``least`` allows decide alone.
    """
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    can = small >= least * large - 1e-9
    out = np.zeros(len(a), bool)
    if can.any():
        x, y = a[can], b[can]
        more, less = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
        same = x.shape[1] - more - less
        share = (n_a[can] / (n_a[can] + n_b[can]))[:, None]
        # A set cannot be more alike than its smaller part allows.
        top = np.minimum(GRID[None, :], (small[can] / large[can])[:, None])
        fit = log_likelihood(more, less, same, share, top)
        high = log_likelihood(more, less, same, share, np.maximum(top, np.minimum(least, (small[can] / large[can])[:, None])))
        out[can] = high.max(axis=1) >= fit.max(axis=1) - doubt
    return out
