"""Top-k, WARC and the pipeline."""

import base64
import hashlib
import random

import pytest

from strandweave.llm import topk, warc

VECTORS = "vec_id long, embedding array<float>, rank int, score string"


def test_top_k_equals_brute_force(spark):
    rng = random.Random(1)
    vectors = {i: [rng.gauss(i % 5, 1) for _ in range(8)] for i in range(0, 420)}
    vectors.update({i: vectors[3] for i in range(500, 560)})
    rows = [(i, v, 1, "x") for i, v in vectors.items()] + [(600, None, 1, "x"), (601, [1.0, None], 1, "x"), (602, [float("nan")], 1, "x"), (650, [float("inf")] * 8, 1, "x"), (None, [1.0] * 8, 1, "x"), (603, [], 1, "x"), (604, [9.0], 1, "x")]
    df = spark.createDataFrame(rows, VECTORS)
    import numpy as np

    q = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in vectors.items()} | {603: [], 604: [2304]}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = {}
    for a in (i for i in q if i % 50 == 0):
        ranked = sorted(((-dot(q[a], q[b]), b) for b in q if b != a))[:5]
        want[a] = [(k + 1, b, -s) for k, (s, b) in enumerate(ranked)]
    for options in ({}, {"data_block": 40, "query_block": 3, "pivots": 7}, {"pivots": 1}):
        found = {}
        for r in topk.top_k(df, **options).collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {k: sorted(v) for k, v in found.items()} == want


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, ""), (50, [3.0, 4.0], 1, ""), (50, [3.0, 4.0], 1, "")], VECTORS)
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(df).collect())
    assert found == [(0, 1, 50), (50, 1, 0)]
    assert topk.top_k(df.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, file string, offset long"


def pages_of(spark):
    big = "<p>" + "é" * 70_000
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "other\r\n\r\nbody"), (4, "http://a/4\nx", None), (5, "http://ü/5", ""), (6, "u", big), (7, "u", big), (None, "u", "same"), (None, "u", "alone"), (8, "u", "rep"), (8, "u", "rep")]
    return spark.createDataFrame([(*r, "f", 0) for r in rows], PAGES), rows


def test_archives_round_trip(spark):
    df, rows = pages_of(spark)
    found = warc.archive_and_read(df, payload=True).collect()
    assert len(found) == len(rows)
    payload = {}
    for p, _, h in rows:
        payload.setdefault(p, set()).add(h or "")
    for r in found:
        options = [h for h in payload[r["page_id"]] if base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() == r["payload_digest"]]
        assert len(options) == 1
        html = options[0]
        assert r["payload_bytes"] == len(html.encode())
        ids = [p for p, _, h in rows if (h or "") == html and p is not None]
        first = min(ids, default=None)
        if r["page_id"] == first:
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]).decode() == html
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == first and r["payload"] is None


def test_small_payloads_are_responses(spark):
    df, _ = pages_of(spark)
    found = warc.archive_and_read(df, least_bytes=1000).collect()
    assert sorted(r["page_id"] for r in found if r["record_type"] == "revisit") == [7]
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_ranges_are_joined():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 500, 5), ("b", 0, 3), ("b", 3, 100)]
    groups = list(warc.joined_ranges(places, gap=30, most=60))
    assert groups == [places[:3], places[3:4], places[4:5], places[5:]]
    assert list(warc.joined_ranges([])) == []


def test_records_are_checked():
    data = warc.record_bytes(1, "http://x/", b"abc", warc.payload_digest(b"abd"), None)
    with pytest.raises(ValueError):
        warc.parse_record(data)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    words = {"en": [f"the{x}ing" for x in "abcdefghij"] + ["and", "of", "that"], "fr": [f"les{x}tion" for x in "éèabcdefgh"] + ["et", "une", "être"]}
    rows = []
    for i in range(120):
        lang = rng.choice(list(words))
        text = ". ".join(" ".join(rng.choice(words[lang]) + rng.choice("abcdefghijkl") for _ in range(9)) for _ in range(8)) + "."
        rows.append((i, text, lang, "s", len(text)))
    rows += [(200 + i, rows[0][1], rows[0][2], "s", 0) for i in range(3)]
    rows += [(300, "12345 !!", "en", "s", 8), (301, None, None, "s", None), (302, rows[5][1] + " password=abcdefgh12345", rows[5][2], "s", 0)]
    rows.append((303, "The quick words of this one. my token: abcdefghijklmnop is here with other words.", "en", "s", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert not {300, 301} & set(seen[names[0]]) and len(seen[names[0]]) == len(rows) - 2
    assert not {200, 201, 202} & set(seen[names[1]])
    assert set(range(120)) - set(seen[names[1]]) == set()
    assert all("abcdefghijklmnop" not in t and "password=abcdefgh12345" not in t for t in seen[names[3]].values())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(seen[names[3]])
