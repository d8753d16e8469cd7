"""Hashes of many substrings of a text at once, with numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240101)
# A random number for every byte value, so that the polynomial does not depend on the values themselves.
_OF_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WINDOW = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, size: int) -> np.ndarray:
    out = np.empty(size, dtype=np.uint64)
    out[0] = 1
    done, factor = 1, base
    while done < size:
        more = min(done, size - done)
        out[done : done + more] = out[:more] * np.uint64(factor)
        factor = factor * factor & _MASK
        done += more
    return out


class _Powers:
    """Powers of the base and of its inverse, as many as have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            size = max(size, 2 * len(self.up))
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any byte ranges of one text; equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: bytes | np.ndarray):
        self.bytes = np.frombuffer(data, dtype=np.uint8) if isinstance(data, bytes) else data
        self.up, self.down = _POWERS.get(len(self.bytes) + 1)
        self.sums = np.zeros(len(self.bytes) + 1, dtype=np.uint64)
        np.cumsum(_OF_BYTE[self.bytes] * self.up[: len(self.bytes)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each maximal run of bytes other than white space."""
    spans = Spans(data)
    space = np.ones(len(spans.bytes) + 2, dtype=bool)
    space[1:-1] = _IS_SPACE[spans.bytes]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return spans.hash(edges[::2], edges[1::2])


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """The distinct hashes of all runs of ``size`` words, sorted; a shorter text with words is one run."""
    words = word_hashes(data)
    if not len(words):
        return words
    runs = len(words) - size + 1
    if runs < 1:
        short = np.uint64(len(words)) + (words * _WINDOW[: len(words)]).sum(dtype=np.uint64)
        return mix(np.array([short], dtype=np.uint64))
    total = np.zeros(runs, dtype=np.uint64)
    for at in range(size):
        total += words[at : at + runs] * _WINDOW[at]
    return np.unique(mix(total))
