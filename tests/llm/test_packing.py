"""Packing: a brute-force best fit, and exact round trips of token ids."""

import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from strandweave.llm import packing
from strandweave.llm.queries import packed, tokenizer_file


def plain_best_fit(lengths, window):
    room, where = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(r, s) for s, r in enumerate(room) if r >= lengths[i]]
        if fits:
            s = min(fits)[1]
        else:
            room.append(window)
            s = len(room) - 1
        room[s] -= lengths[i]
        where[i] = s
    return sorted(room)


@pytest.mark.parametrize("window", [1, 7, 64, 100, 2048])
def test_best_fit_equals_brute_force(window):
    rng = random.Random(window)
    lengths = [rng.randint(1, window) for _ in range(400)]
    sequence, offset, made = packing.best_fit_decreasing(lengths, window)
    used = [0] * made
    for s, n in zip(sequence, lengths, strict=True):
        used[s] += n
    assert sorted(window - u for u in used) == plain_best_fit(lengths, window)
    for s in range(made):
        at = sorted((o, n) for o, n, t in zip(offset, lengths, sequence, strict=True) if t == s)
        assert [o for o, _ in at] == [sum(n for _, n in at[:i]) for i in range(len(at))]


def test_no_lengths():
    assert packing.best_fit_decreasing([], 8) == ([], [], 0)


def test_pieces_add_up_to_the_tokens(spark):
    texts = ["", None, "one two", "x " * 9000, "line\nline  two\tthree   four", "Éa ñ ß 'll we've 12 34!!", "end<|endoftext|>", "\n\n  a"] + [f"text number {i} " * (i % 50) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, start long")
    found = packing.pack(docs, ranks_path=tokenizer_file("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, window=64, pool=50).collect()
    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in own for x in np.frombuffer(r["ids"], "<u4").tolist()] == want
        assert all(r["doc_tokens"] == len(want) for r in own)
        assert [r["start"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))]
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= 64
    assert len(places) * 64 < 1.1 * sum(r["length"] for r in found)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, ranks_path=tokenizer_file("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN).count() == 0


def test_special_tokens_have_the_ids_of_the_json_file(spark):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "two  <|endoftext|>\n<|endoftext|> tabs\t<|endoftext|", "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    found = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packed(docs).collect()}
    assert found == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
