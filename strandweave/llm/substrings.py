"""Substring dedup by sliding sentence spans.

A run has at least ``sentences`` consecutive sentences and ``words`` words, or is one
sentence of ``long_words`` words.  All runs are made up of the shortest ones that begin or
end at a sentence; these are hashed on 128 bits and joined over the whole corpus.  In
order of documents and places the first occurrence of a run stays, and every sentence that
a later occurrence covers is removed.

Passages of ``long_words`` words or more need no sentence bounds.  Of each such window of
words the least of its hashed ``ANCHOR``-word pieces is its anchor, so equal windows have
equal anchors.  The windows of an anchor that repeats are hashed and joined as runs are,
unless runs cover all of its later places, and the words of later windows are removed; of
a sentence that is partly in a passage, ``EDGE`` words or more.

Hashes are counted before the join, so only repeated runs are joined to their
occurrences; both sides are dealt out for the join, whose skewed partitions AQE splits.

Memory: texts are taken together up to 256K characters, a longer one alone; its code points
and the hashes of its words are held.

Defined cases: the order of documents is that of ``doc_id``, nulls last, then of a hash of
the text; rows that repeat both are one document and get the same text; a null text stays
null, an empty one empty; a text without repeated runs stays as it is, byte for byte.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandweave.plans.workspace import Workspace
from strandweave.llm.words import Words, code_points, double_hashes, gram_hashes, together, word_places
from strandweave.llm.workers import bounded_batches, named, tidied

#: Words of the pieces that anchor windows, at most half of a window.
ANCHOR = 25
#: Words of a sentence that a passage must have for them to go without the rest of the sentence.
EDGE = 5
#: A sentence ends behind its mark and white space, or with its line.
_SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?]+(?!\s)[^\n.!?]*)*[.!?]*\s*")


def split_sentences(text: str) -> list[str]:
    """Pieces that add up to ``text``, each a sentence with the white space behind it."""
    return [s for s in _SENTENCE.findall(text) if s]


def runs(texts: list[str], sentences: int, words: int, long_words: int) -> tuple[np.ndarray, ...]:
    """``(text, from, to, h1, h2)`` of the runs of some texts; ``from`` and ``to`` count words.

    From each sentence the shortest run that begins there, and to each sentence the shortest
    that ends there: every longer run is made up of such ones.
    """
    w = Words(texts)
    if not len(w.hashes):
        return (np.empty(0, np.int64),) * 5
    sizes = [np.fromiter(map(len, split_sentences(t)), np.int64) for t in texts]
    ends = np.concatenate([at + np.cumsum(x) for at, x in zip(w.text_start, sizes, strict=False)])
    # the number of words before each sentence that has any, over all texts, and of all words
    upto = np.unique(np.concatenate([[0], np.searchsorted(w.start, ends)]))
    sizes, i = np.diff(upto), np.arange(len(upto) - 1)
    text = w.text_of(upto[:-1])
    # sentences before each text
    bound = np.searchsorted(upto, w.first)
    stop = np.maximum(np.searchsorted(upto, upto[:-1] + words), i + sentences)
    start = np.minimum(np.searchsorted(upto, upto[1:] - words, side="right") - 1, i + 1 - sentences)
    alone = sizes >= long_words
    forward, back = (stop <= bound[text + 1]) & ~alone, (start >= bound[text]) & ~alone
    first = np.concatenate([i[forward], start[back], i[alone]])
    last = np.concatenate([stop[forward], i[back] + 1, i[alone] + 1])
    both = np.unique(first * len(upto) + last)
    text = text[both // len(upto)]
    first, last = upto[both // len(upto)], upto[both % len(upto)]
    return (text, first - w.first[text], last - w.first[text], *double_hashes(w.hashes, first, last))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each ``span`` neighbours is, the first in a tie: by doubling the neighbours."""
    at, size = np.arange(len(values)), 1

    def lesser(a, b):
        return np.where(values[b] < values[a], b, a)

    while 2 * size <= span:
        at = lesser(at[: len(at) - size], at[size:])
        size *= 2
    rest = span - size
    return lesser(at[: len(at) - rest], at[rest:]) if rest else at


def anchors(texts: list[str], window: int) -> tuple[np.ndarray, ...]:
    """``(text, hash, low, high)``: each anchor with its first and last window, windows named by their first word."""
    size = min(ANCHOR, (window + 1) // 2)
    w = Words(texts)
    if len(w.hashes) < window:
        return (np.empty(0, np.int64),) * 4
    pieces = gram_hashes(w.hashes, size)
    at = _least(pieces, window - size + 1)
    text = w.text_of(np.arange(len(at)))
    inside = np.flatnonzero(np.arange(len(at)) + window <= w.first[text + 1])
    if not len(inside):
        return (np.empty(0, np.int64),) * 4
    at, text = at[inside], text[inside]
    turns = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (text[1:] != text[:-1])) + 1, [len(at)]])
    text, low, high = text[turns[:-1]], inside[turns[:-1]], inside[turns[1:] - 1]
    return text, pieces[at[turns[:-1]]].view(np.int64), low - w.first[text], high - w.first[text]


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of integers of a column; an empty one for null."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _joined(texts: list[str], function, width: int) -> list[np.ndarray]:
    """What a function gives for lists of texts put together; its first array says which text of the list."""
    parts, done = [(np.empty(0, np.int64),) * width], 0
    for some in together(texts):
        text, *others = function(some)
        parts.append((text + done, *others))
        done += len(some)
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _covered(start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in any of the intervals."""
    return np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1))[:n] > 0


def _text_hash() -> Column:
    return F.xxhash64("text").alias("hash")


def repeated_spans(docs: DataFrame, work: Workspace, *, sentences: int = 2, words: int = 16, long_words: int = 50) -> DataFrame:
    """``(doc_id, hash, starts, stops)``: per document its runs that are not the first of their kind, in words."""

    def run(batches):
        for b in batches:
            row, start, stop, h1, h2 = _joined(b.column(2).to_pylist(), lambda texts: runs(texts, sentences, words, long_words), 5)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(h1), pa.array(h2)], names=["doc_id", "hash", "from", "to", "h1", "h2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("text IS NOT NULL").select("doc_id", _text_hash(), "text")
    spans = work.save(rows.mapInArrow(tidied(run), f"doc_id {kind}, hash bigint, from int, to int, h1 bigint, h2 bigint"), "spans")
    repeated, found = _repeated(spans, ["h1", "h2"], "from", work)
    cut = work.save(_by_document(repeated.where(_place("from") != F.col("o"))), "cut")
    work.drop(found)
    return cut


def _by_document(rows: DataFrame) -> DataFrame:
    """``(doc_id, hash, starts, stops)`` from rows of ``(doc_id, hash, from, to)``."""
    return rows.groupBy("doc_id", "hash").agg(F.collect_list("from").alias("starts"), F.collect_list("to").alias("stops"))


def _place(at: str) -> Column:
    """The order of places: documents, null ids last, then where in the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("doc_id"), F.col("hash").alias("hash"), F.col(at).alias("at"))


def _moved(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the same whole numbers as keys, but for Spark other columns: a join deals them out anew, and AQE can split its skewed partitions."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0)) for k in keys})


def _repeated(rows: DataFrame, keys: list[str], at: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The rows whose keys are in several places, with the first place as ``o``, and the saved table that they come from.

    rows: ``(doc_id, hash, ...)``, a saved table, which is dropped.  Most keys are in one
    place: counting them needs the keys alone, and only what is left is put in order.
    """
    several = rows.groupBy(*keys).count().where("count > 1").select(*keys)
    found = work.save(rows.join(_moved(several, keys), keys), "found")
    work.drop(rows)
    seen = found.groupBy(*keys).agg(F.min(_place(at)).alias("o"), F.max(_place(at)).alias("last")).where("o != last")
    return found.join(_moved(seen.select(*keys, "o"), keys), keys), found


def repeated_windows(docs: DataFrame, cut: DataFrame, work: Workspace, *, window: int) -> DataFrame:
    """``(doc_id, hash, starts, stops)``: per document the words in later occurrences of a window.

    cut: the result of ``repeated_spans``, whose words need no windows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("text IS NOT NULL").select("doc_id", _text_hash(), "text")

    def anchored(batches):
        for b in batches:
            row, h, low, high = _joined(b.column(2).to_pylist(), lambda texts: anchors(texts, window), 4)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(h), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["doc_id", "hash", "h", "low", "high"])

    def uncovered(batches):
        for b in batches:
            found = [np.empty(0, np.int64)]
            for h, low, high, start, stop in zip(*map(_lists, b.columns), strict=True):
                n = max(high.max(initial=0) + window, stop.max(initial=0))
                before = np.concatenate([[0], np.cumsum(~_covered(start, stop, n))])
                found.append(h[before[high + window] > before[low]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["h"])

    def hashed(batches):
        for b in batches:
            lows, highs = _lists(b.column(3)), _lists(b.column(4))
            texts, parts, done = b.column(2).to_pylist(), [(np.empty(0, np.int64),) * 4], 0
            for some in together(texts):
                w = Words(some)
                before = zip(w.first, lows[done : done + len(some)], highs[done : done + len(some)], strict=False)
                low, high = (np.concatenate(x) for x in zip(*((n + a, n + z) for n, a, z in before), strict=True))
                places = np.flatnonzero(_covered(low, high + 1, len(w.hashes)))
                text = w.text_of(places)
                parts.append((text + done, places - w.first[text], *double_hashes(w.hashes, places, places + window)))
                done += len(some)
            row, at, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at, pa.int32()), pa.array(h1), pa.array(h2)], names=["doc_id", "hash", "at", "h1", "h2"])

    def same(left, right):
        return (left["hash"] == right["_hash"]) & left["doc_id"].eqNullSafe(right["_id"])

    apart = lambda df: df.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    found = work.save(rows.mapInArrow(tidied(anchored), f"doc_id {kind}, hash bigint, h bigint, low int, high int"), "anchors")
    repeated, found = _repeated(found, ["h"], "low", work)
    repeated = work.save(repeated.withColumn("later", _place("low") != F.col("o")).drop("o"), "repeated")
    work.drop(found)
    # an anchor is needed where a later place has words that no run covers
    by_doc = repeated.where("later").groupBy("doc_id", "hash").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("h", "low", "high")])
    spans = apart(cut)
    needed = by_doc.join(spans, same(by_doc, spans), "left").select("hs", "lows", "highs", "starts", "stops").mapInArrow(tidied(uncovered), "h bigint")
    wanted = repeated.join(_moved(needed.distinct(), ["h"]), "h").groupBy("doc_id", "hash").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    wanted = apart(wanted)
    # rows that repeat are one document: their windows are at the same places
    texts = rows.join(wanted, same(rows, wanted)).select("doc_id", "hash", "text", "lows", "highs")
    windows = work.save(texts.mapInArrow(tidied(hashed), f"doc_id {kind}, hash bigint, at int, h1 bigint, h2 bigint"), "windows")
    work.drop(repeated)
    # in the origin's own document the origin's words stay
    own = (F.col("o.none") == F.col("doc_id").isNull()) & (F.col("o.doc_id") == F.coalesce(F.col("doc_id"), F.lit(0))) & (F.col("o.hash") == F.col("hash"))
    start = F.when(own, F.greatest("at", F.col("o.at") + window)).otherwise(F.col("at"))

    def words(df: DataFrame) -> DataFrame:
        later = df.where(_place("at") != F.col("o")).select("doc_id", "hash", start.alias("from"), (F.col("at") + window).alias("to"))
        return later.where(F.col("from") < F.col("to"))

    repeated, found = _repeated(windows, ["h1", "h2"], "at", work)
    words_ = work.save(_by_document(words(repeated)), "words")
    work.drop(found)
    return words_


def without(text: str, runs_: tuple[np.ndarray, np.ndarray], windows: tuple[np.ndarray, np.ndarray]) -> tuple[str, int, int]:
    """``text`` without the sentences of runs and the words of windows, how many sentences it had and how many lost text."""
    parts = split_sentences(text)
    if not len(runs_[0]) and not len(windows[0]):
        return text, len(parts), 0
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    # a word goes with the white space behind it
    at, _ = word_places(code_points(text))
    at, n = np.append(at, len(text)), len(at)
    # which words are in each sentence
    bounds = np.searchsorted(at[:-1], ends)
    size = np.diff(bounds)
    in_run = _covered(*runs_, n)
    # the sentences of a run go whole, with what has no word between them
    whole = np.concatenate([[0], np.cumsum(in_run)])[bounds]
    whole = (np.diff(whole) == size) & (size > 0)
    for i in np.flatnonzero(size == 0):
        whole[i] = i > 0 and i + 1 < len(parts) and whole[i - 1] and bounds[i] < n and in_run[bounds[i]]
    covered = _covered(*windows, n)
    count = np.diff(np.concatenate([[0], np.cumsum(covered)])[bounds])
    # a few words at the edge of a passage may be the sentence's own
    few = (count > 0) & (count < EDGE) & (count < size)
    covered &= ~np.repeat(few, size)
    start, stop = np.concatenate([ends[:-1][whole], at[:-1][covered]]), np.concatenate([ends[1:][whole], at[1:][covered]])
    gone = _covered(start, stop, len(text))
    turns = [0, *(np.flatnonzero(gone[1:] != gone[:-1]) + 1).tolist(), len(text)]
    left = "".join(text[a:b] for a, b in zip(turns, turns[1:], strict=False) if not gone[a])
    lost = np.concatenate([[0], np.cumsum(gone)])[ends]
    return left, len(parts), int((lost[1:] > lost[:-1]).sum())


def remove_repeats(docs: DataFrame, *, sentences: int = 2, words: int = 16, long_words: int = 50, details: bool = False) -> DataFrame:
    """``docs`` with ``text`` free of later occurrences of repeated sentence runs and of passages of ``long_words`` words.

    ``n_chars``, where there is one, follows the text.  With ``details`` the columns are
    ``doc_id``, ``text``, ``n_sentences``, ``n_removed``, the sentences that lost text, and
    ``removed_chars`` instead.
    """
    bounded_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "substrings")
    cut = repeated_spans(docs, work, sentences=sentences, words=words, long_words=long_words)
    words_ = repeated_windows(docs, cut, work, window=long_words)
    runs_, words_ = (df.select("doc_id", "hash", *[F.col(c).alias(f"{c}_{i}") for c in ("starts", "stops")]) for i, df in enumerate((cut, words_)))
    none = F.lit(None).cast("array<int>")
    both = runs_.select("*", none.alias("starts_1"), none.alias("stops_1")).unionByName(words_.select("*", none.alias("starts_0"), none.alias("stops_0")))
    parts = ["starts_0", "stops_0", "starts_1", "stops_1"]
    cut = both.groupBy("doc_id", "hash").agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts])
    kept = ["doc_id", "text"] if details else docs.columns
    rows = docs.select(*map(named, kept))
    types = [f.dataType for f in rows.schema.fields]
    rows = rows.select(F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), "doc_id", _text_hash())
    cut = cut.withColumnRenamed("doc_id", "cut_id")
    rows = rows.join(cut, (rows["hash"] == cut["hash"]) & rows["doc_id"].eqNullSafe(cut["cut_id"]), "left").select("row.*", *parts)
    at = kept.index("text")

    def run(batches):
        for b in batches:
            texts, n, gone, chars = [], [], [], []
            for t, a, z, a_words, z_words in zip(b.column(at), *(_lists(b.column(len(kept) + k)) for k in range(4)), strict=True):
                text = t.as_py()
                left, count, lost = without(text, (a, z), (a_words, z_words)) if text and (details or len(a) or len(a_words)) else (text, 0, 0)
                texts.append(left)
                n.append(count)
                gone.append(lost)
                chars.append(len(text or "") - len(left or ""))
            out = dict(zip(kept, b.columns, strict=False)) | {"text": pa.array(texts, pa.string())}
            if details:
                out |= {"n_sentences": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "removed_chars": pa.array(chars, pa.int64())}
            elif "n_chars" in out:
                changed = pa.array([g > 0 for g in gone])
                sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                out["n_chars"] = pa.compute.if_else(changed, sizes, out["n_chars"].cast(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    fields = [StructField(c, LongType() if c == "n_chars" else t) for c, t in zip(kept, types, strict=True)]
    fields += [StructField(c, LongType()) for c in ("n_sentences", "n_removed", "removed_chars")] * details
    return rows.mapInArrow(tidied(run), StructType(fields))
