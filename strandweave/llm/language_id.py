"""Language identification by rank-order n-gram profiles.

A language's profile is its ``size`` most frequent character n-grams, in order (W. Cavnar
and J. Trenkle, "N-Gram-Based Text Categorization", 1994).  A text's own profile is
compared to each by the out-of-place distance: the sum over its n-grams of how far their
ranks lie apart, ``size`` where the profile lacks one.  The nearest language wins, the
first by name in a tie, and the score is one less the distance's share of its maximum.

N-grams have one to three characters of the lower-cased text; whatever is not a letter
counts as one separator.  Profiles are fitted on at most ``fit_rows`` texts of each
language, taken by a hash of the id; predictions read every text whole.

Memory: a text's code points and n-grams are held, some fifty bytes a character.

Defined cases: a null text and one without a letter are ``und`` with score 0, as is every
text if nothing could be learned; a row with a null id is never learned from and counts
as held out; rows that repeat are predicted alike; other columns are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from strandweave.llm.workers import bounded_batches, tidied

UNKNOWN = "und"
_SEPARATOR = 1
_BITS = 21


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_keys(text: str | None) -> np.ndarray:
    """The n-grams of one to three characters, one integer each, repeats included."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.empty(0, np.int64)
    marked = np.where(is_letter, points, _SEPARATOR)
    marked = np.concatenate([[_SEPARATOR], marked, [_SEPARATOR]])
    marked = marked[np.concatenate([[True], (marked[1:] != _SEPARATOR) | (marked[:-1] != _SEPARATOR)])]
    two = marked[:-1] << _BITS | marked[1:]
    three = two[:-1] << _BITS | marked[2:]
    return np.concatenate([marked[marked != _SEPARATOR], two, three])


def summed(parts, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of many texts and their counts, holding about ``most`` keys at a time."""
    grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[np.ndarray] = []

    def fold():
        own, n = np.unique(np.concatenate(held), return_counts=True)
        every, at = np.unique(np.concatenate([grams, own]), return_inverse=True)
        return every, np.bincount(at, np.concatenate([counts, n]), len(every)).astype(np.int64)

    for keys in parts:
        held.append(keys)
        if sum(map(len, held)) >= most:
            grams, counts = fold()
            held = []
    return fold() if held else (grams, counts)


def top_grams(keys: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order, the smaller key first in a tie."""
    grams, counts = np.unique(keys, return_counts=True)
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:size]


def fit_profiles(labelled: DataFrame, *, size: int = 300, fit_rows: int = 5000) -> dict[str, list[int]]:
    """Profiles by language from ``labelled (doc_id, text, lang)``, all rows of which may be learned from."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    shares = [(r["lang"], min(1.0, fit_rows / r["n"])) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not shares:
        return {}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    by_lang = F.create_map(*[F.lit(x) for pair in shares for x in pair])
    chosen = rows.where(place < by_lang[F.col("lang")]).select("lang", "text")

    def count(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1)
            for lang in sorted(set(langs)):
                grams, counts = summed(gram_keys(t.as_py()) for t, x in zip(texts, langs, strict=True) if x == lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    counts = chosen.mapInArrow(tidied(count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(best.select("lang", "place", "gram").collect()):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Ranker:
    """Distances of texts to a set of profiles."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.langs = size, sorted(profiles)
        self.grams = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in self.langs])) if profiles else np.empty(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        for i, x in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, profiles[x])] = np.arange(len(profiles[x]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        keys = gram_keys(text)
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        own = top_grams(keys, self.size)
        at = np.searchsorted(self.grams, own)
        at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        theirs = self.ranks[:, at]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own))))
        total = apart.sum(axis=1)
        best = int(np.argmin(total))
        return self.langs[best], 1.0 - float(total[best]) / (self.size * len(own))


def predict(docs: DataFrame, profiles: dict[str, list[int]], *, size: int = 300) -> DataFrame:
    """``(doc_id, lang_pred, score)``: the language and its score for each row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        rank = Ranker(profiles, size)
        for b in batches:
            found = [rank(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; true for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, *, size: int = 300, fit_rows: int = 5000) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, learned from rows of ``docs`` that are not held out."""
    learn = docs.where(~held_out()).select("doc_id", "text", "lang")
    found = predict(docs, fit_profiles(learn, size=size, fit_rows=fit_rows), size=size)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, *, size: int = 300, fit_rows: int = 5000, least: float = 0.1) -> DataFrame:
    """``docs`` without texts in no language known: ``und``, or a score under ``least``.

    Columns of any name stay as they are.
    """
    bounded_batches(docs.sparkSession)
    learn = docs.where(~held_out()).select("doc_id", "text", "lang")
    profiles = fit_profiles(learn, size=size, fit_rows=fit_rows)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        rank = Ranker(profiles, size)
        for b in batches:
            found = [rank(t.as_py()) for t in b.column(at)]
            kept = b.filter(pa.array([x != UNKNOWN and s >= least for x, s in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=names)

    # by places, as names may hold points
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(tidied(run), docs.schema)
