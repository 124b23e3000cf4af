"""Hashed words of UTF-8 text, without a Python object for each word."""

from __future__ import annotations

import hashlib

import numpy as np

from lodestar.llm.common import Rolling, mix

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of white space: x20, x09 to x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Bytes that aren't part of a letter run: ASCII but for A-Z and a-z.
NOT_LETTER = np.arange(256) < 128
NOT_LETTER[65:91] = NOT_LETTER[97:123] = False

BLOCK = 1 << 20

#: Longer words get a cryptographic hash: polynomials modulo 2**64 collide on certain words of 1,024 bytes and more, whatever the base.
LONG = 64


class Words:
    """Words of byte rows as 64-bit hashes of their lower-cased bytes; rows of any length, a block at a time."""

    def __init__(self, breaks: np.ndarray, stem: int = 0) -> None:
        """breaks: by byte, if it separates words; stem: if not 0, words are cut to that many bytes."""
        self.breaks, self.stem, self.rolling = breaks, stem, Rolling(17)

    def row(self, data: np.ndarray) -> np.ndarray:
        """The word hashes of one row, in order."""
        if len(data) <= BLOCK:
            return self._hash(data)
        parts, at = [], 0
        while at < len(data):
            end = min(len(data), at + BLOCK)
            if end < len(data):  # cut behind the last break, so that no word is split
                cut = np.flatnonzero(self.breaks[data[at:end]])
                if len(cut):
                    end = at + int(cut[-1]) + 1
                else:
                    more = np.flatnonzero(self.breaks[data[end:]])
                    end = end + int(more[0]) + 1 if len(more) else len(data)
            parts.append(self._hash(data[at:end]))
            at = end
        return np.concatenate(parts)

    def rows(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word hashes of rows end to end, and the bounds of each row's words."""
        if len(data) > BLOCK:
            parts = [self.row(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        starts, ends = self._bounds(data, bounds)
        low = LOWER[data]
        return self._hashes(low, starts, ends), np.searchsorted(starts, bounds, "left")

    def _bounds(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = ~self.breaks[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, np.minimum(ends, starts + self.stem) if self.stem else ends

    def _hash(self, data: np.ndarray) -> np.ndarray:
        return self.rows(data, np.array([0, len(data)]))[0] if len(data) <= BLOCK else self._whole(data)

    def _whole(self, data: np.ndarray) -> np.ndarray:
        starts, ends = self._bounds(data, np.array([0, len(data)]))
        return self._hashes(LOWER[data], starts, ends)

    def _hashes(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = mix(self.rolling.spans(self.rolling.prefix(low), starts, ends))
        for i in np.flatnonzero(ends - starts > LONG):
            out[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out
