"""SentencePiece, substring dedup, secrets, language ID, quality, fingerprints."""

import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece

from strandweave.llm import fingerprints, language_id, quality, secrets, sentencepiece_codec, substrings
from strandweave.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or ""), "q", 0.5) for i, t in enumerate(texts)], DOCS)


# -- SentencePiece


HARD = ["", " ", "a", "  two  blanks ", "line\nbreak\n\n", "Ünïcödé 中文 😀 text", "words wordsworth unbelievable", "\t tab", "x" * 500, "the ▁ mark", "1234 !!! ???"]


def test_ids_equal_the_library(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("abcdehinorst .,\n") for _ in range(200)) for _ in range(40)]
    found = {r["doc_id"]: r for r in sentencepiece_codec.encode(docs_of(spark, [*texts, None]), model_path=path, check=True).collect()}
    for i, t in enumerate(texts):
        assert found[i]["ids"] == library.encode(t), repr(t)
        assert found[i]["round_trip"] == ("▁" not in t)
    assert found[len(texts)]["ids"] is None
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs_of(spark, texts), model_path=path), model_path=path).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: library.decode(library.encode(t)) for i, t in enumerate(texts)}


def test_unigram_relaxation_finds_the_best_sum():
    codec = sentencepiece_codec.Codec(tokenizer_file("piece_bpe_32k.model"))
    codec.model.bpe = False
    scores = codec.model.scores

    def brute(text):
        best = {0: (0.0, [])}
        for i in range(1, len(text) + 1):
            options = [(best[j][0] + scores[codec.ids[text[j:i]]], best[j][1] + [codec.ids[text[j:i]]]) for j in range(i) if j in best and text[j:i] in codec.ids]
            if options:
                best[i] = max(options, key=lambda x: x[0])
        return best[len(text)][0]

    codec = sentencepiece_codec.Codec(tokenizer_file("piece_bpe_32k.model"))
    import ahocorasick

    codec.model.bpe = False
    codec.automaton = ahocorasick.Automaton()
    for p, i in codec.ids.items():
        codec.automaton.add_word(p, (i, len(p)))
    codec.automaton.make_automaton()
    for text in ("▁unbelievable", "▁the", "▁translation", "▁ababab"):
        ids = codec._known(text)
        assert "".join(codec.model.pieces[i] for i in ids) == text
        assert sum(scores[i] for i in ids) == pytest.approx(brute(text))


# -- substring dedup

PASSAGE = "The first sentence of a passage is here. The second one goes on for a while with words. A third sentence ends it with many more words than needed to count. And so on it goes until the end of the whole passage is reached at last."


def test_sentences_add_up():
    for t in (*HARD, PASSAGE, "a.b c. d", "...", "no end", "One!? Two?\nThree", "\n\n\n", "x. \n y."):
        assert "".join(substrings.split_sentences(t)) == t


def test_later_occurrences_go(spark):
    texts = [f"Own opening words of document {i}, unlike all the others. {PASSAGE} Own closing words number {i * 17}, also unlike." for i in range(4)]
    texts += ["A text without any repetition at all, which stays as it is.\n", None, ""]
    found = {r["doc_id"]: r for r in substrings.remove_repeats(docs_of(spark, texts), details=True).collect()}
    assert found[0]["text"] == texts[0]
    for i in (1, 2, 3):
        assert PASSAGE not in found[i]["text"] and "passage" not in found[i]["text"]
        assert f"document {i}" in found[i]["text"] and f"number {i * 17}" in found[i]["text"]
    assert found[4]["text"] == texts[4] and found[5]["text"] is None and found[6]["text"] == ""


def test_runs_equal_brute_force(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randint(2, 12))) + rng.choice([". ", "!\n", "? "]) for _ in range(30)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    # every run of two or more sentences and sixteen or more words, whatever its length
    first, covered = {}, {}
    for d, t in enumerate(texts):
        parts = substrings.split_sentences(t)
        for at in range(len(parts)):
            for end in range(at + 2, len(parts) + 1):
                run = " ".join("".join(parts[at:end]).split())
                if len(run.split()) >= 16 and first.setdefault(run, (d, at)) != (d, at):
                    covered.setdefault(d, set()).update(range(at, end))
    want = {d: "".join(s for i, s in enumerate(substrings.split_sentences(t)) if i not in covered.get(d, ())) for d, t in enumerate(texts)}
    found = {r["doc_id"]: r for r in substrings.remove_repeats(docs_of(spark, texts)).collect()}
    assert {d: r["text"] for d, r in found.items()} == want
    assert all(found[d]["n_chars"] == len(want[d]) for d in want)


def test_rows_that_repeat_are_one_document(spark):
    df = docs_of(spark, [PASSAGE]).unionAll(docs_of(spark, [PASSAGE])).unionAll(docs_of(spark, [PASSAGE], 5))
    assert sorted((r["doc_id"], len(r["text"])) for r in substrings.remove_repeats(df).collect()) == [(0, len(PASSAGE)), (0, len(PASSAGE)), (5, 0)]
    assert substrings.remove_repeats(docs_of(spark, [])).count() == 0


def test_tables_read_once_are_not_saved(spark, monkeypatch):
    """Each file of a scratch table costs its executor processes; there were 20 tables."""
    saved, save = [], substrings.Workspace.save
    monkeypatch.setattr(substrings.Workspace, "save", lambda self, df, name="t": saved.append(name) or save(self, df, name))
    found = substrings.remove_repeats(docs_of(spark, [f"Own words {i}. {PASSAGE}" for i in range(3)])).collect()
    assert [PASSAGE in r["text"] for r in sorted(found, key=lambda r: r["doc_id"])] == [True, False, False]
    assert saved == ["spans", "found", "cut", "anchors", "found", "repeated", "windows", "found", "words"]


def test_moved_keys_are_dealt_out_anew(spark):
    """Without a table between them a join's two sides still have an exchange each, whose skewed partitions can be split."""
    rows = spark.range(-50, 50).selectExpr("id % 7 AS h", "id")
    several = rows.groupBy("h").count().where("count > 14")
    found = rows.join(substrings._moved(several, ["h"]).hint("merge"), "h")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in rows.join(several, "h").collect())


def test_long_passages_inside_sentences_go(spark):
    """Passages of 50 words or more go wherever they begin and end; shorter ones without whole sentences stay."""
    rng = random.Random(12)

    def prose(n):
        return [f"w{rng.randrange(10**6)}" + ("." if rng.random() < 0.06 else "") for _ in range(n)]

    texts, want = [], []
    for n in (50, 51, 60, 80, 200):
        for _ in range(4):
            passage = prose(n)
            for later in (False, True):
                a, b = prose(rng.randint(20, 90)), prose(rng.randint(20, 90))
                texts.append(" ".join(a + passage + b))
                want.append((a, [] if later else passage, b))
    own = " ".join(prose(55)).replace(".", "")
    texts += [f"{own} between {own}", "x " * 300]
    want += [([], [*own.split(), "between"], []), ([], ["x"] * 50, [])]
    found = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(docs_of(spark, texts)).collect()}
    for i, (a, passage, b) in enumerate(want):
        left = found[i].split()
        assert left[: len(a)] == a and left[len(left) - len(b) :] == b
        own = left[len(a) : len(left) - len(b)]
        # at each end fewer than five words of a sentence may stay
        assert own == passage if passage else len(own) <= 2 * (substrings.EDGE - 1)


# -- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(t):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def secret_texts():
    rng = random.Random(3)
    parts = ["password=", "Passwd: ", "SECRET' = \"", "token=secret:", "api_key=", "ApiKey ", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "deadbeef", "short", "abcdefgh", "hunter2hunter2", "é😀", "\n", " ", ":", "=", "'", "ÄÖ", "x" * 40]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", "token=secret:abcdefghijk", "password=abc password=abcdefgh", "ſecret=abcdefghij", "a" * 31, "a" * 32, "AKIA" + "A" * 11, "AKIA" + "A" * 12]


def test_base_spans_equal_python(spark):
    texts = secret_texts()
    found = {r["doc_id"]: r for r in secrets.scan(docs_of(spark, [*texts, None]), secrets.BASE_RULES).collect()}
    for i, t in enumerate([*texts, ""]):
        assert found[i]["spans"] == plain_spans(t), repr(t)
        assert found[i]["base_sha256"] == hashlib.sha256(plain_spans(t).encode()).hexdigest()
        assert found[i]["n_assign"] == plain_spans(t).count("assign")


def test_more_rules_add_spans_only(spark):
    t = "key ghp_" + "a1B2" * 10 + " and -----BEGIN RSA PRIVATE KEY----- password=abcdefgh"
    r = secrets.scan(docs_of(spark, [t])).first()
    assert [x.split(":")[0] for x in r["spans"].split(",")] == ["vcs_token", "private_key", "assign"]
    assert r["base_sha256"] == hashlib.sha256(plain_spans(t).encode()).hexdigest()


def test_trigram_queries():
    assert secrets.trigram_query("abcd") == ("and", ["abc", "bcd"])
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("x(foo|bar)y*") == ("or", [("and", ["bar", "xba"]), ("and", ["foo", "xfo"])])
    assert secrets.trigram_query("ab?c") is None
    assert secrets._grams(secrets.trigram_query(secrets.BASE_RULES[0].pattern)) >= {"pas", "tok", "ssw", "_ke"}


def test_queries_admit_every_match():
    """A text that a rule matches holds the trigrams of its query."""
    def holds(q, t):
        return True if q is None else q in t if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, t) for x in q[1])

    for rule in secrets.BASE_RULES + secrets.MORE_RULES:
        q = secrets.trigram_query(rule.pattern)
        for t in [*secret_texts(), "ghp_" + "a" * 36, "xoxb-1234567890", "eyJabcdefgh.eyJabcdefgh.x", "-----BEGIN PRIVATE KEY-----"]:
            if re.search(rule.pattern, t, re.A):
                assert holds(q, t.lower())


def test_redaction(spark):
    texts = ["a password=abcdefgh b", "nothing", None, "deadbeef" * 4 + "token=" + "0123456789abcdef" * 2]
    found = {r["doc_id"]: r for r in secrets.redact(docs_of(spark, texts)).collect()}
    assert found[0]["text"] == "a [secret] b" and found[0]["n_chars"] == 12
    assert found[1]["text"] == "nothing" and found[2]["text"] is None
    assert found[3]["text"] == "[secret]"
    assert secrets.redact(docs_of(spark, [])).count() == 0


# -- language ID

WORDS = {"en": "the and of that with for this have from they which would there".split(), "de": "der die und nicht mit für über eine werden auch schön".split(), "fr": "le la les des une être avec pour dans qui élève où".split()}


def labelled(spark, n=240, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 60))), lang, "s", 0, "", 0.0))
    return spark.createDataFrame(rows, DOCS), {r[0]: r[2] for r in rows}


def test_held_out_languages(spark):
    df, truth = labelled(spark)
    found = language_id.identify(df).collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 30 and all(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_labels_of_held_out_rows_are_not_read(spark):
    from pyspark.sql import functions as F

    df, _ = labelled(spark)
    spoiled = df.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    key = lambda d: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(d).collect())
    assert key(df) == key(spoiled)


def test_texts_without_letters(spark):
    df, _ = labelled(spark)
    odd = df.unionAll(docs_of(spark, [None, "", "123 !?", "  "], 1000)).unionAll(spark.createDataFrame([(None, "the and of", "en", "s", 1, "", 0.0)], DOCS))
    found = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in range(1000, 1004))
    assert found[None]["lang_pred"] == "en" and found[None]["held_out"]
    kept = language_id.drop_unidentified(odd)
    assert kept.columns == odd.columns and kept.count() == df.count() + 1


def test_profiles_equal_brute_force(spark):
    df, truth = labelled(spark, 60)
    counts = {}
    for r in df.collect():
        t = " " + " ".join("".join(c if c.isalpha() else " " for c in r["text"].lower()).split()) + " "
        grams = [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]
        for g in grams:
            if g != " ":
                counts.setdefault(r["lang"], {}).setdefault(g, 0)
                counts[r["lang"]][g] += 1
    def key(g):
        k = 0
        for c in g:
            k = k << 21 | (1 if c == " " else ord(c))
        return k
    want = {lang: [key(g) for g, _ in sorted(c.items(), key=lambda x: (-x[1], key(x[0])))[:50]] for lang, c in counts.items()}
    assert language_id.fit_profiles(df, size=50) == want


def test_nothing_to_learn_from(spark):
    df = docs_of(spark, ["some text"]).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert language_id.identify(df).first()["lang_pred"] == "und"
    assert language_id.identify(df.limit(0)).count() == 0


# -- quality


def quality_rows(spark, n=400, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice("river stone walked quiet morning because letter under window".split()) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(20, 200))]
        text = " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words)) if good else " ".join([rng.choice(words).upper() + "!!"] * rng.randint(20, 200))
        docs.append((i, text, "en", "s", 0, "", 0.0))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {x[0]: x[1] for x in labels}


def test_held_out_quality(spark):
    docs, labels, truth = quality_rows(spark)
    found = quality.score_quality(docs.unionAll(docs_of(spark, ["", None], 5000)), labels).collect()
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    empty = {r["score"] for r in found if r["doc_id"] >= 5000}
    assert len(empty) == 1


def test_sums_and_densities_equal_numpy(spark):
    docs, labels, truth = quality_rows(spark, 80)
    rows = quality.with_statistics(docs).join(labels, "doc_id")
    sums = quality.class_sums(rows.select("quality", "x"))
    x = {r["doc_id"]: np.array(r["x"]) for r in rows.collect()}
    for k in (0, 1):
        own = np.array([x[i] for i in x if truth[i] == k])
        assert sums[k][0] == len(own) and np.allclose(sums[k][1], own.sum(axis=0)) and np.allclose(sums[k][2], own.T @ own)
    model = quality.Discriminant(sums)
    every = np.array(list(x.values()))
    assert model.score(every).shape == (len(every),)


def test_one_class_or_none(spark):
    docs = docs_of(spark, ["a b c", "d e f"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (1, 1), (1, None), (99, 0)], "doc_id long, quality int")
    assert all(0.5 <= r["score"] <= 1 for r in quality.score_quality(docs, one).collect())
    assert quality.score_quality(docs.limit(0), one).count() == 0


# -- fingerprints


def test_edits_equal_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdé 😀\n") for _ in range(rng.randint(0, 60))) for _ in range(50)] + ["", None, "x"]
    docs = docs_of(spark, texts)
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    order = sorted(range(len(texts)), reverse=True)
    assert len(found) == len(texts)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = texts[i] or "", texts[j] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        r = found[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, after = (fingerprints.fingerprint(x) for x in (t, edited, nxt))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{own:016x}", f"{other:016x}")
        assert r["near_edited"] == 1 - (own ^ other).bit_count() / 64 and r["near_next"] == 1 - (own ^ after).bit_count() / 64


def test_single_row_follows_itself_and_nulls_come_last(spark):
    one = fingerprints.fingerprint_edits(docs_of(spark, ["abcdef"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.fingerprint_edits(docs_of(spark, [])).count() == 0
    df = docs_of(spark, ["aaa", "bbb"]).unionAll(spark.createDataFrame([(None, "ccc", "en", "s", 3, "", 0.0)], DOCS)).unionAll(docs_of(spark, ["aaa"]))
    found = fingerprints.fingerprint_edits(df).collect()
    assert len(found) == 4
    null = next(r for r in found if r["doc_id"] is None)
    assert null["edited_sha256"] == hashlib.sha256(b"ccb").hexdigest()


def test_lookup_equals_brute_force(spark):
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for p in prints]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed + signed[:3] + [None]], "print long")
    asked = spark.createDataFrame([(p,) for p in signed[::4]], "query long")
    for radius, blocks in ((3, 6), (3, 4), (1, 2)):
        found = {(r["query"], r["print"], r["distance"]) for r in fingerprints.within_radius(asked, df, radius=radius, blocks=blocks).collect()}
        want = {(a, b, d) for a in signed[::4] for b in signed if (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= radius}
        assert found == want
