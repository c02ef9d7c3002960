"""Words and hashes of many texts at a time, as numpy arrays.

All texts of a batch become one array of code points. A polynomial hash of any stretch follows from its prefix sums
modulo 2^64: the sum over the stretch, times the inverse power of its start.
"""

from __future__ import annotations

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_word_table = None
KEPT_POWERS = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def is_word() -> np.ndarray:
    """For every code point below U+10000: is it a letter or a digit?"""
    global _word_table
    if _word_table is None:
        _word_table = np.fromiter((chr(c).isalnum() for c in range(0x10000)), bool, 0x10000)
    return _word_table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd multiplier modulo 2^64, and of its inverse. A bounded number of them is kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    found = []
    for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
        steps = np.full(max(n, KEPT_POWERS), base, np.uint64)
        steps[0] = 1
        found.append(np.multiply.accumulate(steps))
    if len(found[0]) == KEPT_POWERS:
        _powers[:] = found
    return found[0][:n], found[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def top_bits(h: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(h) >> np.uint64(64 - bits)).astype(np.int64)


def segments(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + lengths[0] - 1, starts[1], ...: the places of many stretches, one after the other."""
    if not len(starts):
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


class Split:
    """The words of some texts: runs of letters and digits, lower-cased; in scripts without spaces each character.

    chars: code points, 0 where there is no word; starts, ends: of every word; counts: words of each text.
    """

    def __init__(self, texts: list[str]):
        low = [text.lower() for text in texts]
        code = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "replace"), np.uint32)
        word = is_word()[np.minimum(code, 0xFFFF)] | (code > 0xFFFF)
        alone = word & (code >= 0x2E80) & ((code < 0xA000) | (code > 0xFFFF))
        joined = word & ~alone
        self.starts = np.flatnonzero(word & (alone | ~np.roll(joined, 1)))
        self.ends = np.flatnonzero(word & (alone | ~np.roll(joined, -1))) + 1
        self.chars = np.where(word, code, 0).astype(np.uint64)
        forward, self._back = powers(len(code))
        self._summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.chars + np.uint64(1)) * forward, dtype=np.uint64)])
        bounds = np.cumsum([1, *(len(text) + 1 for text in low)])
        self.counts = np.diff(np.searchsorted(self.starts, bounds))

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A hash of every word, or of its first ``most`` characters."""
        ends = self.ends if most is None else np.minimum(self.starts + most, self.ends)
        return (self._summed[ends] - self._summed[self.starts]) * self._back[self.starts]


def shingles(split: Split, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of n words, and of which text each is. A shorter text that has words is one run."""
    h = mixed(split.hashes())
    first = np.cumsum(split.counts) - split.counts
    runs = np.where(split.counts > 0, np.maximum(1, split.counts - n + 1), 0)
    at = segments(first, runs)
    text = np.repeat(np.arange(len(runs)), runs)
    last = (first + split.counts)[text]
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = at + k < last
        term = h[np.minimum(at + k, max(0, len(h) - 1))] if len(h) else out
        out = out * np.uint64(0x100000001B3) + np.where(inside, term, np.uint64(0x51ED27))
    return mixed(out), text
