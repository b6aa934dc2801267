"""Best-fit-decreasing packing of tokenised documents into fixed windows.

A document that is longer than a window is first cut into full windows; what remains is
placed, longest first, into the open window that it fits most tightly.  A segment tree
indexed by remaining capacity holds how many windows are open at each capacity and finds
the tightest one in ``log2(window)`` steps.

Pieces are packed in pools of ``pool`` pieces while a task reads its documents, so no row
is shuffled and memory is bounded by one pool; a pool's last windows are the only ones
that best fit leaves much room in.  A task that is run again reads the same split and
gives the same sequences.

Defined cases: a null text is empty; an empty text still has its end token, one piece;
documents that repeat are packed each; other columns are not read; no rows, no pieces.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from strandweave.llm.workers import bounded_batches, tidied

#: Entries of the per-process memo from a chunk of text to its tokens.
MEMO_ENTRIES = 200_000
#: Characters tokenised at a time within one very long text.
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")


class CapacityTree:
    """How many open windows there are at each remaining capacity, as a segment tree."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` at which a window is open."""
        at = need + self.leaves
        if not self.count[at]:
            # up to the first ancestor with a right sibling that holds a window
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                at += not self.count[at]
        return at - self.leaves

    def take(self, capacity: int) -> int:
        self._change(capacity, -1)
        return self.open[capacity].pop()


def best_fit_decreasing(lengths: Iterable[int], window: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset for each length (at most ``window``), and how many sequences there are."""
    lengths = list(lengths)
    sequence, offset, made = [0] * len(lengths), [0] * len(lengths), 0
    tree = CapacityTree(window)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.tightest(lengths[i])
        if room is None:
            room, sequence[i] = window, made
            made += 1
        else:
            sequence[i] = tree.take(room)
        offset[i] = window - room
        if room > lengths[i]:
            tree.add(room - lengths[i], sequence[i])
    return sequence, offset, made


class TokenMemo(dict):
    """Token bytes (little-endian unsigned 32-bit) by chunk of text."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        found = self[chunk] = np.array(self.encode(chunk), "<u4").tobytes()
        return found


class ByteBpe:
    """Byte-level BPE of whole texts.

    No pre-token of the pattern goes from a non-space to a space after it, so a text may
    be cut there and the chunks' ids memoised; a text with white space other than blanks
    and line ends is encoded whole.  Ids equal those of the JSON file of the same
    vocabulary, whose library is several times slower on these texts (see the README).
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo = TokenMemo(self.encoding.encode_ordinary)

    def __call__(self, text: str) -> bytes:
        if _OTHER_SPACE.search(text):
            return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()
        return b"".join(map(self.memo.__getitem__, _CHUNK.findall(text)))


def added_tokens(json_path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file, whose text is one id each wherever it stands."""
    with open(json_path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError("added tokens that take in or depend on the text around them are not supported")
    return {t["content"]: t["id"] for t in found}


def with_specials(encode: Callable[[str], bytes], specials: dict[str, int]) -> Callable[[str], bytes]:
    """``encode`` for the text between special tokens, and their ids for these."""
    if not specials:
        return encode
    mark = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")
    known = {t: np.array([i], "<u4").tobytes() for t, i in specials.items()}

    def run(text: str) -> bytes:
        parts = mark.split(text)
        return encode(text) if len(parts) == 1 else b"".join(known[p] if k % 2 else encode(p) for k, p in enumerate(parts))

    return run


_TOKENIZERS: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(ranks_path: str, pattern: str) -> ByteBpe:
    """One tokenizer for each worker process."""
    if (ranks_path, pattern) not in _TOKENIZERS:
        _TOKENIZERS[ranks_path, pattern] = ByteBpe(ranks_path, pattern)
    return _TOKENIZERS[ranks_path, pattern]


FIELDS = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, *, ranks_path: str, pattern: str, window: int = 2048, end_id: int = 1, pool: int = 8192, specials: dict[str, int] | None = None) -> DataFrame:
    """Pieces of ``docs (doc_id, text)`` placed in sequences of at most ``window`` ids.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit numbers; ``start`` is the
    number of its document's ids before it, ``doc_tokens`` the document's ids with the end
    id, ``sequence_id`` and ``offset`` the place.  Offsets in a sequence have no gap.
    ``specials`` are texts that are one id each; without it all text is ordinary.
    """
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    end, full = np.array([end_id], "<u4").tobytes(), 4 * window

    def placed(pieces: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
        """A pool's pieces in the sequences from ``first`` on."""
        sequence, offset, made = best_fit_decreasing((p[2] for p in pieces), window)
        columns = [list(c) for c in zip(*pieces, strict=True)] + [[first + s for s in sequence], offset]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema), first + made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = with_specials(byte_bpe(ranks_path, pattern), specials or {})
        next_id, pieces, held = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer(text.as_py() or "") + end
                total = len(ids) // 4
                for at in range(0, len(ids), full):
                    pieces.append((doc, at // 4, min(window, total - at // 4), ids[at : at + full], total))
                if len(pieces) >= pool:
                    out, next_id = placed(pieces, next_id)
                    pieces = []
                    yield out
        if pieces:
            yield placed(pieces, next_id)[0]

    return docs.select("doc_id", "text").mapInArrow(tidied(run), FIELDS)
