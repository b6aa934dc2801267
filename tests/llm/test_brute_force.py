"""Queries that SQL can't express, against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandweave.llm import fingerprints, language_id, quality, secrets, topk
from strandweave.llm.words import Words
from tests.llm.test_simhash import plain_components
from tests.llm.test_tables import VECTORS
from tests.llm.test_text_operators import ASSIGN, docs_of, labelled, secret_texts

VERY_LONG = " ".join(f"word{i % 4099}" for i in range(120_000))


def test_all_kinds_of_secrets(spark):
    texts = secret_texts() + ["ghp_" + "a1B2" * 10 + " gho_" + "x" * 36 + "gh", "xoxb-1234567890 xoxz-1234567890", "eyJabcdefgh.eyJabcdefgh.x eyJa.eyJb.c", "-----BEGIN PRIVATE KEY----------BEGIN RSA PRIVATE KEY-----"]
    texts += ["xoxb-" + "a" * 10 + " ", "token: abcdefgh; " * 5000, VERY_LONG + " password=abcdefgh"]
    rules = [("assign", ASSIGN, 8, 2)] + [(r.kind, re.compile(r.pattern, re.A), r.least, r.group) for r in (secrets.BASE_RULES + secrets.MORE_RULES)[1:]]

    def spans(t):
        found = [(m.start(), i, k, m.end()) for i, (k, p, least, group) in enumerate(rules) for m in p.finditer(t) if len(m[group]) >= least]
        return sorted(found)

    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert found[i] == ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans(t)), t[:100]

    def clean(t):
        gone = [False] * len(t)
        starts = set()
        upto = 0
        for a, _, _, b in spans(t):
            if a > upto or not upto:
                starts.add(a)
            gone[a:b] = [True] * (b - a)
            upto = max(upto, b)
        return "".join("[secret]" * (i in starts) + ("" if g else c) for i, (c, g) in enumerate(zip(t, gone, strict=True)))

    cleaned = {r["doc_id"]: r["text"] for r in secrets.redact(docs_of(spark, texts)).collect()}
    assert all(cleaned[i] == clean(t) for i, t in enumerate(texts))


def test_index_blocks(spark, monkeypatch):
    """Small blocks give the same spans, and each block's postings are of its own texts."""
    texts = secret_texts()
    want = sorted(map(tuple, secrets.scan(docs_of(spark, texts)).collect()))
    monkeypatch.setattr(secrets, "BLOCK_TEXTS", 20)
    assert sorted(map(tuple, secrets.scan(docs_of(spark, texts + texts[:50])).where(F.col("doc_id") < len(texts)).collect())) == want
    work = secrets.Workspace(spark, "test")
    index = secrets.build_index(docs_of(spark, texts), ["pas", "tok"], work).collect()
    assert len({r["block"] for r in index}) > 5 and {r["gram"] for r in index} == {"pas", "tok"}
    assert sum(len(r["texts"]) for r in index if r["gram"] == "tok") == len({t for t in texts if "tok" in t.lower()})


def test_any_column_names_are_kept(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh1", 2, "x", 3), (2, None, 4, "y", 5)], "doc_id long, text string, mask int, `a.b` string, row long")
    assert sorted(map(tuple, secrets.redact(df).collect())) == [(1, "[secret]", 2, "x", 3), (2, None, 4, "y", 5)]


def plain_profile(texts, size):
    tally = Counter()
    for t in texts:
        s = "\x01" + "".join(c if c.isalpha() else "\x01" for c in t.lower()) + "\x01"
        s = re.sub("\x01+", "\x01", s)
        for n in (1, 2, 3):
            tally.update(g for i in range(len(s) - n + 1) if (g := s[i : i + n]) != "\x01")
    return [g for g, _ in sorted(tally.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:size]]


def test_out_of_place_distance(spark):
    df, _ = labelled(spark, 90, 8)
    size = 40
    rows = {r["doc_id"]: r for r in df.collect()}
    held = {r["doc_id"]: r["held_out"] for r in language_id.identify(df, size=size).collect()}
    langs = sorted({r["lang"] for r in rows.values()})
    profiles = {x: plain_profile([r["text"] for i, r in rows.items() if r["lang"] == x and not held[i]], size) for x in langs}
    for r in language_id.identify(df, size=size).collect():
        own = plain_profile([rows[r["doc_id"]]["text"]], size)
        apart = {x: sum(abs(i - p.index(g)) if g in p else size for i, g in enumerate(own)) for x, p in profiles.items()}
        best = min(langs, key=lambda x: (apart[x], x))
        assert (r["lang_pred"], r["score"]) == (best, 1 - apart[best] / (size * len(own)))


def test_unidentified_documents_go(spark):
    df, _ = labelled(spark, 90, 8)
    odd = docs_of(spark, [None, "12345 !!", ""], 500).withColumnRenamed("spans", "lang_pred")
    docs = df.withColumnRenamed("spans", "lang_pred").unionAll(odd).withColumn("a.b", F.lit("x"))
    kept = language_id.drop_unidentified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(90))
    assert language_id.drop_unidentified(docs.limit(0)).count() == 0


def test_quality_scores(spark):
    """Scores equal those of two normal densities written out with determinants and inverses."""
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["steady", "river", "of", "the", "mind", "Paris", "grows", "slowly,", "and", "ends."]) for _ in range(rng.randint(30, 90)))
    bad = lambda: " ".join(rng.choice(["BUY", "now!!!", "$$$", "9999", "click", "x"]) for _ in range(rng.randint(5, 60)))
    texts = [good() if i % 2 else bad() for i in range(160)] + ["", None, VERY_LONG]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    x = np.array([quality.statistics(t) for t in texts])
    learn = [i for i in range(160) if not found[i]["held_out"]]
    part = {k: x[[i for i in learn if i % 2 == k]] for k in (0, 1)}
    cov = {k: np.cov(v.T, bias=True) for k, v in part.items()}
    pooled = sum(len(v) * cov[k] for k, v in part.items()) / len(learn)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    density = []
    for k, v in part.items():
        own = (0.9 * cov[k] + 0.1 * pooled) / np.outer(scale, scale)
        own = 0.95 * own + 0.05 * np.trace(own) / len(own) * np.eye(len(own))
        z = (x - v.mean(axis=0)) / scale
        density.append(np.log(len(v)) - 0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(own), z) + np.linalg.slogdet(own)[1]))
    for i in range(len(texts)):
        want = 1 / (1 + math.exp(-max(-500, min(500, (density[1][i] - density[0][i]) / 3))))
        assert found[i]["score"] == pytest.approx(want, abs=1e-6) and found[i]["predicted"] == (found[i]["score"] >= 0.7)


def plain_fingerprint(text):
    votes = [0] * 64
    for w, n in Counter((text or "").lower().split()).items():
        h, weight = xxhash.xxh64_intdigest(w.encode()), round(1024 * (1 + math.log(n)))
        votes = [v + (weight if h >> i & 1 else -weight) for i, v in enumerate(votes)]
    return sum(1 << i for i, v in enumerate(votes) if v > 0)


def test_fingerprints_and_groups(spark):
    rng = random.Random(9)
    base = [f"term{i}" for i in range(400)]
    texts = [None, "", "one", VERY_LONG]
    for _ in range(12):
        own = [rng.choice(base) for _ in range(300)]
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(own))
            own = list(own)
            own[rng.randrange(300)] = rng.choice(base)
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs_of(spark, texts), radius=3).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    groups = plain_components(prints, 3)
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""
        third = len(t) // 3
        edited = plain_fingerprint(t[: len(t) - third] + following[:third])
        assert found[i]["fingerprint"] == f"{prints[i]:016x}" and found[i]["edited_fingerprint"] == f"{edited:016x}"
        assert found[i]["near_edited"] == 1 - (prints[i] ^ edited).bit_count() / 64 and found[i]["near_next"] == 1 - (prints[i] ^ prints[i - 1]).bit_count() / 64
    of_group = {}
    for i, g in enumerate(groups):
        of_group.setdefault(g, set()).add(found[i]["near_group"])
    assert all(len(x) == 1 for x in of_group.values()) and len(set.union(*of_group.values())) == len(of_group) > 8
    assert fingerprints.fingerprint_edits(docs_of(spark, []), radius=3).count() == 0


def test_top_k_of_clusters(spark):
    """Cells far apart, one vector many times and ids that repeat."""
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(40 * (i % 7 == j), 0.5) for j in range(7)]) for i in range(700)] + [(1000 + i, [9.0] * 7) for i in range(300)] + [(50, [3.0] * 7), (50, [50.0] * 7), (51, [80.0] * 7), (51, [81.0] * 7)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], VECTORS)
    q = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors]
    want = {}
    for a in {i for i, _ in q if i % 50 == 0}:
        best = {}
        for own in (v for i, v in q if i == a):
            for b, v in q:
                if b != a:
                    s = sum(x * y for x, y in zip(own, v, strict=True))
                    best[b] = max(s, best.get(b, s))
        want[a] = [(k + 1, b, s) for k, (b, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
    for options in ({}, {"data_block": 50, "query_block": 4, "pivots": 12}):
        found = {}
        for r in topk.top_k(df, **options).collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {k: sorted(v) for k, v in found.items()} == want


def test_words_together_and_alone():
    texts = ["", " a  b", "ab\tc", "Ä　ö", "a b", VERY_LONG, "x"]
    w = Words(texts)
    for i, t in enumerate(texts):
        own = w.hashes[w.first[i] : w.first[i + 1]]
        assert len(own) == len(t.split()) and (own == Words([t]).hashes).all()
    assert len(np.unique(Words([" ".join(f"{a}{b}" for a in range(300) for b in "xyz")]).hashes)) == 900
