"""Document quality by regularised quadratic discriminant analysis.

Statistics of a text are transformed towards normality.  Each class has a mean and a
covariance shrunk towards the pooled covariance and then towards a multiple of the
identity (J. Friedman, "Regularized Discriminant Analysis", 1989).  The Cholesky factor
of each covariance is kept, so a row's Mahalanobis distances are two triangular solves;
the score is a logistic function of the difference of the classes' log densities.

Classes are fitted from counts, sums and cross products over every labelled row that is
not held out, added up by task; only those sums reach the driver.

Defined cases: a null text is an empty one, whose statistics are zeros; a label that is
null, or whose document is missing, is not learned from; a row with a null id counts as
held out; with one class only, or none, each score is that class's smoothed share; rows
that repeat score alike; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.language_id import held_out
from strandweave.plans.workspace import Workspace
from strandweave.llm.workers import bounded_batches, tidied

_SYMBOL = re.compile(r"[^\w\s.,;:'\"()\-]")
#: Upper-case letters of the ASCII and Latin-1 ranges.
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_END = re.compile(r"[.!?]+(?=\s|$)")
STATISTICS = 18


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; shares as arcsines of their roots, sizes as logarithms."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * STATISTICS
    tally = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = len(_END.findall(text))
    upper = len(_UPPER.findall(text))
    symbols = len(_SYMBOL.findall(text))
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    shares = [
        len(tally) / n,
        max(tally.values()) / n,
        same / n,
        pairs / max(1, n - 1),
        upper / chars,
        symbols / chars,
        len(_DIGIT.findall(text)) / chars,
        float((lengths <= 3).mean()),
        float((lengths == 1).mean()),
        ends / n,
        sum(w[0].isupper() for w in words) / n,
        sum(map(str.isupper, words)) / n,
        1 - len(set(lines)) / len(lines),
    ]
    sizes = [np.log1p(chars), np.log(lengths.mean()), np.log1p(lengths.std()), np.log(chars / len(lines)), np.log1p(n / (ends + 1))]
    return [float(x) for x in [*np.arcsin(np.sqrt(np.clip(shares, 0, 1))), *sizes]]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)`` with the statistics of each text."""

    def run(batches):
        for b in batches:
            flat = [v for t in b.column(1) for v in statistics(t.as_py())]
            offsets = pa.array(np.arange(0, len(flat) + 1, STATISTICS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64()))], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, x array<double>")


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), STATISTICS)


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and cross products by class of ``rows (quality, x)``."""
    d = STATISTICS

    def run(batches):
        sums = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for b in batches:
            labels, x = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1))
            for k in sums:
                own = x[labels == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([k for k in sums for _ in sums[k]], pa.int32()), pa.array([i for k in sums for i in range(len(sums[k]))], pa.int32()), pa.array([v for k in sums for v in sums[k]], pa.float64())], names=["k", "i", "v"])

    added = rows.select(F.col("quality").cast("int"), "x").mapInArrow(tidied(run), "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    found = {}
    for k in (0, 1):
        v = np.zeros(1 + d + d * d)
        for r in added:
            if r["k"] == k:
                v[r["i"]] = r["v"]
        found[k] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return found


class Discriminant:
    """Two normal densities with cached Cholesky factors."""

    def __init__(self, sums, *, to_pooled: float = 0.1, to_identity: float = 0.05, temperature: float = 3.0):
        self.temperature = temperature
        n = {k: sums[k][0] for k in sums}
        self.share = (n[1] + 1) / (n[0] + n[1] + 2)
        self.fitted = min(n.values()) >= 2
        if not self.fitted:
            return
        mean = {k: sums[k][1] / n[k] for k in sums}
        scatter = {k: sums[k][2] - n[k] * np.outer(mean[k], mean[k]) for k in sums}
        pooled = sum(scatter.values()) / sum(n.values())
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.parts = []
        for k in sorted(sums):
            own = (1 - to_pooled) * scatter[k] / n[k] + to_pooled * pooled
            own = own / np.outer(self.scale, self.scale)
            own = (1 - to_identity) * own + to_identity * max(1e-6, np.trace(own) / len(own)) * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.parts.append((mean[k], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n[k])))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher where class 1 is likelier."""
        if not self.fitted:
            return np.full(len(x), self.share)
        density = []
        for mean, inverse, log_det, log_prior in self.parts:
            z = ((x - mean) / self.scale) @ inverse.T
            density.append(log_prior - (np.square(z).sum(axis=1) + log_det) / 2)
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / self.temperature, -500, 500)))


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, to_pooled: float = 0.1, to_identity: float = 0.05, temperature: float = 3.0) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs (doc_id, text)``.

    ``labels (doc_id, quality)`` are learned from where the id is not held out.
    """
    bounded_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "quality")
    rows = work.save(with_statistics(docs), "statistics")
    known = labels.where("quality IN (0, 1)").where(~held_out()).select("doc_id", "quality")
    model = Discriminant(class_sums(rows.join(known, "doc_id").select("quality", "x")), to_pooled=to_pooled, to_identity=to_identity, temperature=temperature)

    def run(batches):
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(tidied(run), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
