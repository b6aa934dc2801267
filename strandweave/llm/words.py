"""Words of a text and hashes of runs of them, without a loop over words.

A text is an array of code points.  The hash of a span of an array is a sum of its values
times powers of an odd base, moved to the span's start and scrambled; sums over prefixes
give the hash of any span, so all words of a text are hashed at once, and all runs of words
from the words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

#: Odd bases of two independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Powers are kept for arrays up to this length.
_KEPT = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    made = _POWERS.get(base)
    if made is None or len(made[0]) < n:
        size = max(n, 1 << 12) if n > _KEPT else min(_KEPT, 1 << max(12, n.bit_length()))
        made = tuple(np.cumprod(np.full(size, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64)))
        if size <= _KEPT:
            _POWERS[base] = made
    return made[0][:n], made[1][:n]


def span_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of the values from each ``start`` to before its ``stop``; equal spans have equal ones."""
    if not len(start):
        return np.empty(0, np.uint64)
    powers, inverse = _powers(base, len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * powers, out=sums[1:])
    return mix((sums[stop] - sums[start]) * inverse[start] + mix((stop - start).astype(np.uint64)))


def double_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each span, in two signed parts."""
    return tuple(span_hashes(v, start, stop, base).view(np.int64) for v, base in ((values, BASES[0]), (mix(values), BASES[1])))


@cache
def _space(ascii_only: bool) -> np.ndarray:
    return np.fromiter((chr(i).isspace() and not (ascii_only and (i > 32 or 13 < i < 32)) for i in range(0x110000)), bool, 0x110000)


def code_points(text: str, lower: bool = False) -> np.ndarray:
    """The text's code points; with ``lower`` A-Z in lower case."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points) if lower else points


def word_places(points: np.ndarray, ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end: runs of anything but white space, or but the blanks of ``[\\x20\\x09-\\x0D]``."""
    inside = np.zeros(len(points) + 2, bool)
    np.logical_not(_space(ascii_only)[points], out=inside[1:-1])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


class Words:
    """The words of several texts: hashes, places in the texts put end to end, and how many are before each text."""

    def __init__(self, texts: list[str], lower: bool = False, ascii_only: bool = False):
        # a blank between texts parts their words
        points = code_points(" ".join(texts), lower)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        #: Where each text begins, and where the next one would.
        self.text_start = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.start, self.stop = word_places(points, ascii_only)
        self.hashes = span_hashes(points, self.start, self.stop)
        self.first = np.searchsorted(self.start, self.text_start)

    def text_of(self, word: np.ndarray) -> np.ndarray:
        """Which text a word is in."""
        return np.searchsorted(self.first, word, side="right") - 1


#: Characters of texts that are taken together.
_TOGETHER = 1 << 18


def together(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in lists of bounded size; a longer one is alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > _TOGETHER:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of a text."""
    return Words([text]).hashes


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words from the words' hashes."""
    start = np.arange(max(0, len(hashes) - n + 1))
    return span_hashes(hashes, start, start + n)
