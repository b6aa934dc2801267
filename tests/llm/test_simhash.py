"""Covering LSH against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import xxhash

from strandweave.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, id string"


def rows(pairs):
    return [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in pairs]


def plain_print(text, width):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(prints, radius):
    """Smallest id reachable, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(prints))]


def test_masks_cover_every_difference():
    rng = random.Random(1)
    for radius in (1, 2, 3, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(500):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(diff & m == 0 for m in masks)


def test_masks_cover_over_free_bits_only():
    rng = random.Random(2)
    free = sum(1 << b for b in rng.sample(range(64), 20))
    masks = simhash.covering_masks(3, free)
    assert all(m & ~free == 0 for m in masks)
    for _ in range(200):
        diff = sum(1 << b for b in rng.sample([b for b in range(64) if free >> b & 1], 3))
        assert any(diff & m == 0 for m in masks)


def near_texts(n=60, seed=3):
    """Texts of which many are copies with a word or two changed."""
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([40, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            edited = list(base)
            for _ in range(rng.randint(0, 2)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts.append(" ".join(edited))
    return texts[:n]


def check_components(spark, texts, run_limit):
    docs = spark.createDataFrame(rows(enumerate(texts)), SCHEMA)
    found = {r["doc_id"]: r for r in simhash.simhash_components(docs, width=3, radius=3, run_limit=run_limit).collect()}
    prints = [plain_print(t, 3) for t in texts]
    assert [found[i]["print"] & (1 << 64) - 1 for i in range(len(texts))] == prints
    assert [found[i]["component_id"] for i in range(len(texts))] == plain_components(prints, 3)


def test_components_equal_brute_force(spark):
    check_components(spark, [*near_texts(), None, "", "   ", "one", "Two words", "two WORDS", "a\tb\nc"], simhash.RUN_LIMIT)


def test_long_buckets_are_covered_again(spark):
    """With a limit of two members each bucket is split, and no link is lost."""
    check_components(spark, near_texts(40, 5), 2)


def test_forest_links_what_is_linked():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = np.array([b ^ np.uint64(1 << int(rng.integers(64))) for b in base for _ in range(12)], np.uint64)
    ids = np.arange(len(prints))
    a, b = simhash.forest(prints, ids, 3)
    assert len(a) == len(prints) - len(set(plain_components([int(p) for p in prints], 3)))
    assert all((int(prints[i]) ^ int(prints[j])).bit_count() <= 3 for i, j in zip(a, b, strict=True))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame(rows([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "quite another text here")]), SCHEMA)
    found = simhash.simhash_components(docs).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in found) == [(-1, -1), (-1, 7), (7, 7), (7, 7)]
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 7]


def test_one_of_each_group_stays(spark):
    rng = random.Random(6)
    vocabulary = [f"longer{i}" for i in range(2000)]
    texts, groups = [], []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(200)]
        for _ in range(rng.randint(1, 4)):
            edited = list(base)
            for _ in range(rng.randint(0, 2)):
                edited[rng.randrange(200)] = rng.choice(vocabulary)
            texts.append(" ".join(edited))
            groups.append(g)
    docs = spark.createDataFrame(rows(enumerate(texts)), SCHEMA)
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(kept) == [groups.index(g) for g in range(25)]


def test_similarity_decides(spark):
    """Candidates below the similarity stay apart."""
    base = [f"token{i}" for i in range(100)]
    far = [w if i % 8 else f"other{i}" for i, w in enumerate(base)]
    docs = spark.createDataFrame(rows([(0, " ".join(base)), (1, " ".join(far))]), SCHEMA)
    assert simhash.drop_near_duplicates(docs).count() == 2
    assert simhash.jaccard("a b c d e f", "a b c d e f", 5) == 1.0
    assert simhash.jaccard("", None, 5) == 1.0
    assert simhash.jaccard("a", "b", 5) == 0.0


def plain_kept(texts, sketches=simhash.SKETCHES, radius=simhash.RADIUS, width=5, similarity=0.8):
    """Texts that stay if all candidates are compared."""
    prints = [simhash.word_prints([t], sketches) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if any((p ^ q).bit_count() <= radius for p, q in zip(prints[i], prints[j], strict=True)) and simhash.jaccard(texts[i], texts[j], width) >= similarity:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return sorted({find(i) for i in range(len(texts))})


def star_texts(copies, changed, seed, words=360):
    """A text and copies that are similar to it but mostly not to each other."""
    rng = random.Random(seed)
    base = [rng.choice(VOCABULARY) for _ in range(words)]
    texts = [" ".join(base)]
    for c in range(copies):
        edited = list(base)
        for i in range(changed):
            edited[rng.randrange(words)] = f"changed{c}of{i}"
        texts.append(" ".join(edited))
    return texts


VOCABULARY = [f"longer{i}" for i in range(4000)]


def test_all_candidates_are_compared(spark):
    """Copies that are similar to one text only are found, whichever text the buckets put first."""
    texts = star_texts(120, 8, 7) + star_texts(40, 9, 8) + star_texts(300, 8, 9)
    docs = spark.createDataFrame(rows(enumerate(texts)), SCHEMA)
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == plain_kept(texts)


def test_sparse_links_connect_the_same(spark):
    """Also where long buckets are covered again."""
    rng = np.random.default_rng(13)
    prints = {int(rng.integers(1 << 62))} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    base = min(prints)
    prints = sorted(prints | {base ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 4), replace=False)) for _ in range(150)})
    nodes = spark.createDataFrame([(p, 0) for p in prints], "print long, sketch int")
    for run_limit in (simhash.RUN_LIMIT, 16):
        work, found = simhash.Workspace(spark, "test"), []
        for sparse in (False, True):
            links = simhash._buckets(nodes, 4, work, run_limit, sparse=sparse).collect()
            parent = {p: p for p in prints}

            def find(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in links:
                parent[max(find(a), find(b))] = min(find(a), find(b))
            found.append([prints.index(find(p)) for p in prints])
        assert found[0] == found[1] == plain_components(prints, 4)


def test_a_text_is_in_one_cluster_a_sketch(spark, monkeypatch):
    """However many buckets its near copies share, so rows to compare grow with the texts."""
    texts, compared, most = star_texts(200, 8, 7), simhash._compared, []

    def counted(rest, *args):
        most.append(rest.groupBy("id").count().agg({"count": "max"}).first()[0])
        return compared(rest, *args)

    monkeypatch.setattr(simhash, "_compared", counted)
    docs = spark.createDataFrame(rows(enumerate(texts)), SCHEMA)
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == plain_kept(texts)
    assert most and max(most) <= simhash.SKETCHES


def test_small_units_and_wide_clusters(spark, monkeypatch):
    """Clusters of many units, and those that are read by their buckets, lose no link."""
    texts = star_texts(100, 8, 7) + star_texts(60, 9, 8)
    docs = spark.createDataFrame(rows(enumerate(texts)), SCHEMA)
    monkeypatch.setattr(simhash, "UNIT", 8)
    for wide in (simhash.WIDE, 10):
        monkeypatch.setattr(simhash, "WIDE", wide)
        assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == plain_kept(texts)


def test_more_equal_prints_than_the_limit(spark):
    """A group of distinct texts with one fingerprint, which no mask parts, ends and is compared."""
    words = [f"longer{i}" for i in range(40)]
    rng = random.Random(11)
    texts = [" ".join(rng.sample(words, 40)) for _ in range(12)] + [" ".join(words[:20] + [f"b{i}"] + words[20:]) for i in range(12)]
    assert len({tuple(simhash.word_prints([t], 6)) for t in texts}) == 1
    docs = spark.createDataFrame(rows(enumerate(texts)), SCHEMA)
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs, run_limit=4, similarity=0.7).collect()) == plain_kept(texts, similarity=0.7)


def test_recall_against_all_pairs(spark):
    """Of pairs with a similarity of 0.8 or more at least 95 in 100 are in one group."""
    rng = random.Random(12)
    texts = []
    for g in range(150):
        words = rng.randint(150, 500)
        base = [rng.choice(VOCABULARY) for _ in range(words)]
        edited = list(base)
        for i in range(int(words * rng.uniform(0.005, 0.022))):
            edited[rng.randrange(words)] = f"changed{g}of{i}"
        texts += [" ".join(base), " ".join(edited)]
    pairs = [(i, i + 1) for i in range(0, 300, 2) if simhash.jaccard(texts[i], texts[i + 1], 5) >= 0.8]
    docs = spark.createDataFrame(rows(enumerate(texts)), SCHEMA)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert len(pairs) > 100 and sum(b not in kept for _, b in pairs) >= 0.95 * len(pairs)
    assert all(i in kept for i in range(0, 300, 2))


def test_any_column_names(spark):
    """Columns named like helpers, or with points, stay as they are."""
    docs = spark.createDataFrame([(1, "a b c", 5, 6, "x", 7), (2, "a b c", 8, 9, "y", 1), (3, "", 1, 1, "z", 2)], "doc_id long, text string, h1 long, keep_id long, `a.b` string, id long")
    assert sorted(map(tuple, simhash.drop_near_duplicates(docs).collect())) == [(1, "a b c", 5, 6, "x", 7), (3, "", 1, 1, "z", 2)]
    assert simhash.simhash_components(docs).count() == 3


def test_very_long_text(spark):
    words = [f"w{i % 977}" for i in range(200_000)]
    text = " ".join(words)
    assert simhash.shingle_print(text, 3) == plain_print(text, 3)
    docs = spark.createDataFrame(rows([(0, text), (1, text + " more"), (2, "short")]), SCHEMA)
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == [0, 2]
