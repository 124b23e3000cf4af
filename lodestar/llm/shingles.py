"""Hashed word shingles and bottom-k sketches."""

from __future__ import annotations

import numpy as np

from lodestar.llm.common import mix
from lodestar.llm.words import SPACE, Words

WIDTH = 5
KEYS = np.random.Generator(np.random.PCG64(99)).integers(1, 2**63, 64, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """The set of hashed shingles of a text: words are runs without x20 and x09 to x0D, with A-Z lower-cased."""

    def __init__(self, width: int = WIDTH) -> None:
        self.width, self.words = width, Words(SPACE)

    def row(self, data: np.ndarray) -> np.ndarray:
        """Distinct hashes in ascending order; a text of fewer words than a shingle has one for all, an empty one none."""
        return self.of(self.words.row(data))

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        width = min(self.width, len(h))
        total = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            total += h[j : len(h) - width + 1 + j] * KEYS[j]
        return np.unique(mix(total))


def signature(shingles: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    a = mix(shingles ^ KEYS[10]).sum(dtype=np.uint64)
    b = mix(shingles ^ KEYS[11]).sum(dtype=np.uint64)
    return np.array([a, b + np.uint64(len(shingles))], np.uint64).tobytes()
