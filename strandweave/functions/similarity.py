"""Fuzzy text scores between 0 and 100, from the length of the longest common subsequence.

``ratio`` is twice that length over the texts' summed lengths.  ``token_set_ratio``
compares what two texts' word sets share and where they differ, 100 if one holds the
other.  ``partial_ratio`` is the best ratio of the shorter text with any window of the
longer, windows cut off at its ends included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one machine integer a row."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        hit = rest & places.get(c, 0)
        rest = (rest + hit | rest - hit) & full
    return len(a) - rest.bit_count()


def ratio(a: str, b: str) -> float:
    return 200 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    gap = 1 if both else 0
    first, second = len(both) + gap + len(only_x), len(both) + gap + len(only_y)
    # the shared words and the blank behind them are equal in both texts
    scores = [200 * (len(both) + gap + lcs_length(only_x, only_y)) / (first + second)]
    if both:
        scores += [200 * len(both) / (len(both) + n) for n in (first, second)]
    return max(scores)


def partial_ratio(a: str, b: str) -> float:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n, best = len(short), 0.0
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    for w in windows:
        # no window of this length can do better than this
        if 200 * min(n, len(w)) / (n + len(w)) > best:
            best = max(best, ratio(short, w))
    return best


def score(query: str, value: str) -> float:
    """The better of the two scores; the partial one only for values at least as long as the query."""
    q, v = query.lower(), value.lower()
    return max(token_set_ratio(q, v), partial_ratio(q, v) if len(v) >= len(q) else 0.0)


def fuzzy_score(query: str):
    """A vectorised column function: the score of each text against the query."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            for t in texts.dropna().unique():
                if t not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[t] = score(query, t)
            yield texts.map(known)

    return run
