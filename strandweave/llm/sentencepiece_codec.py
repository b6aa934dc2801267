"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over all pieces reads a text once.  At each position its output links give
the pieces that end there, and each is relaxed against the best state at its start:

* for a unigram model the state is the best sum of scores, as in Viterbi's algorithm;
* for a BPE model sums of scores do not give the ids that merging gives, so the state is
  the last piece of the prefix's encoding, and a piece is taken if merging the two
  neighbours' text gives back just those two.  Exactly one piece passes at each position,
  as neighbouring pieces that all pass are the merging result of their text.

Texts are cut before white space where no piece goes across, and the cuts' ids memoised
in each worker.  Characters without a piece become byte pieces, or the unknown piece in a
model without them.

Defined cases: a null text has null ids; an empty text none; rows that repeat are encoded
alike; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from strandweave.llm.workers import bounded_batches, tidied

SPACE = "▁"
MEMO_ENTRIES = 300_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _wire(data: bytes):
    """Fields ``(number, value)`` of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """A model file's pieces and settings."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_wire(f.read()))
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        for number, value in fields:
            if number == 1:
                own = dict(_wire(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
        trainer, normal = (dict(_wire(next((v for n, v in fields if n == k), b""))) for k in (2, 3))
        self.bpe = trainer.get(3, 1) == 2
        if not self.bpe and trainer.get(3, 1) != 1:
            raise ValueError("only unigram and BPE models are encoded")
        if normal.get(2):
            raise ValueError("a model with a character map of its own is not supported")
        self.dummy_prefix, self.tidy, self.escape = bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}

    def normalise(self, text: str) -> str:
        if self.tidy:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text


class Codec:
    """Encoder and decoder of one model; one for each worker process."""

    def __init__(self, path: str):
        import ahocorasick

        self.model = m = Model(path)
        self.ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k in (NORMAL, USER)}
        self.rank = {p: m.scores[i] for p, i in self.ids.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if not m.bpe or self.merged(p) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.single = {p for p in self.ids if len(p) == 1}
        across = re.compile(f"[^{SPACE}]{SPACE}")
        if any(across.search(p) for p in self.ids):
            self.cut = None
        elif any("\n" in p for p in self.ids):
            self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
        self.memo: dict[str, bytes] = {}
        raw = [b"" if k in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]
        self.raw = raw

    def merged(self, text: str) -> list[str]:
        """Pieces that merging gives: the best-scored neighbours first, the leftmost in a tie."""
        parts = list(text)
        while True:
            best = max(((self.rank[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.rank), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _fit(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) >= 4 * MEMO_ENTRIES:
                self.fits.clear()
            x, y = self.model.pieces[a], self.model.pieces[b]
            self.fits[key] = self.merged(x + y) == [x, y]
        return self.fits[key]

    def _known(self, text: str) -> list[int]:
        """Ids of a text of which each character is a piece."""
        n = len(text)
        last: list[int | None] = [None] * (n + 1)
        if self.model.bpe:
            fit = self._fit
            for end, (piece, size) in self.automaton.iter(text):
                i = end + 1
                if last[i] is None:
                    start = i - size
                    if start == 0 or (last[start] is not None and fit(last[start], piece)):
                        last[i] = piece
        else:
            best = [-np.inf] * (n + 1)
            best[0] = 0.0
            for end, (piece, size) in self.automaton.iter(text):
                score = best[end + 1 - size] + self.model.scores[piece]
                if score > best[end + 1]:
                    best[end + 1], last[end + 1] = score, piece
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(self.model.pieces[last[i]])
        return out[::-1]

    def _encode(self, chunk: str) -> list[int]:
        out, run = [], []
        unknown_before = False

        def close():
            nonlocal run
            if run:
                out.extend(self._known("".join(run)))
                run = []

        for c in chunk:
            if c in self.single:
                run.append(c)
                unknown_before = False
                continue
            close()
            if self.model.bytes:
                out.extend(self.model.bytes[b] for b in c.encode("utf-8", "surrogatepass"))
            elif not unknown_before:
                out.append(self.model.unknown)
                unknown_before = True
        close()
        return out

    def encode(self, text: str) -> np.ndarray:
        normal = self.model.normalise(text)
        if self.cut is None:
            return np.array(self._encode(normal), np.int32)
        memo, parts = self.memo, []
        for chunk in self.cut.findall(normal):
            got = memo.get(chunk)
            if got is None:
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                got = memo[chunk] = np.array(self._encode(chunk), np.int32).tobytes()
            parts.append(got)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, *, model_path: str, check: bool = False) -> DataFrame:
    """``(doc_id, ids)`` of ``docs (doc_id, text)``; with ``check`` also whether decoding gives the text back."""

    bounded_batches(docs.sparkSession)

    def run(batches):
        c = codec(model_path)
        for b in batches:
            ids, same = [], []
            for t in b.column(1):
                text = t.as_py()
                own = None if text is None else c.encode(text)
                ids.append(own)
                same.append(None if text is None else not check or c.decode(own) == text)
            sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
            flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in ids]))
            yield pa.RecordBatch.from_arrays([b.column(0), lists] + [pa.array(same, pa.bool_())] * check, names=["doc_id", "ids"] + ["round_trip"] * check)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, ids array<int>" + ", round_trip boolean" * check)


def decode(rows: DataFrame, *, model_path: str) -> DataFrame:
    """``(doc_id, text)`` of ``rows (doc_id, ids)``; null ids give a null text."""

    def run(batches):
        c = codec(model_path)
        for b in batches:
            texts = [None if x.as_py() is None else c.decode(np.array(x.as_py(), np.int32)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(tidied(run), f"doc_id {kind}, text string")
