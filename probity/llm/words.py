"""Words of whole slices of texts as 64-bit hashes, and hashes of stretches of them, without a Python object for each word.

A word is what stands between [\\x20\\x09-\\x0D]. Its hash is a polynomial modulo 2**64 over numbers drawn for its bytes; the hash of a
stretch of words is one over the words' hashes, so that both are differences of prefix sums.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time, so few that the numbers for them stay in a processor's cache.
_CHUNK = 1 << 16
_DRAWN = np.random.default_rng(17).integers(0, 1 << 64, 258, np.uint64) | np.uint64(1)
_LETTERS, _P, _Q = _DRAWN[:256], _DRAWN[256], _DRAWN[257]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as many as were asked for so far."""

    def __init__(self, base: np.uint64):
        self.bases = (int(base), pow(int(base), -1, 1 << 64))
        self.held = [np.ones(1, np.uint64)] * 2

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) < n:
            size = 1 << (n - 1).bit_length()
            for k, base in enumerate(self.bases):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                self.held[k] = np.cumprod(steps, dtype=np.uint64)
        return self.held[0][:n], self.held[1][:n]


_of_bytes, _of_words = _Powers(_P), _Powers(_Q)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Sums:
    """Hashes of stretches of a sequence of token hashes."""

    def __init__(self, words: np.ndarray):
        powers, self.inverse = _of_words(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[: len(words)], dtype=np.uint64)])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def all_of(self, n: int) -> np.ndarray:
        """Of every stretch of ``n`` words."""
        return mixed((self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n])


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of all words of texts that begin at ``offsets``; no word goes on from one text to the next."""
    word = (data != 32) & (data - np.uint8(9) > 4)
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = word[edge]
    ends[edge - 1] = word[edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(out):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(stops, low + _CHUNK, "right")))
        high = stops[to - 1]
        powers, inverse = _of_bytes(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_LETTERS.take(data[low:high]) * powers[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, stops[at:to] - low
        out[at:to] = mixed((sums.take(e) - sums.take(s)) * inverse.take(s) + (e - s).astype(np.uint64))
        at = to
    return starts, stops, out
