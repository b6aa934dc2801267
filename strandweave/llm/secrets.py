"""Secret scanning with trigram queries, in DataFrame expressions only.

For each rule a Boolean trigram query is derived from the parsed regular expression: the
strings that every match must hold, cut into trigrams, joined by AND along a sequence and
by OR over alternatives (R. Cox, "Regular Expression Matching with a Trigram Index",
2012).  The inverted index has a row for each block of texts and trigram of the queries
with its postings: the hashes of the block's texts that hold it in lower case.  A block
has about ``BLOCK_TEXTS`` distinct texts, so no list of postings grows with the corpus.
Postings are intersected and united block by block as the queries say; documents whose text
is a candidate are verified with the rule's expression, and a rule with no mandatory
trigram scans every text.  A hash that two texts share only gives one more candidate.

Spans are ``kind:start:end`` in code points, the end exclusive, ordered by start and then
by the rules' order.  The leftmost matches that do not overlap are taken for each rule;
those whose counted group is too short are dropped afterwards.

Places are added up by blocks of matches, so a text with very many matches costs little
more than its length; texts are read whole, whatever their length.

Defined cases: a null text is an empty one, without spans; rows that repeat and null ids
give a row each; ``scan`` reads no other columns and ``redact`` keeps them, whatever their
names; of spans that touch or overlap ``redact`` makes one mark; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.workers import packed_row
from strandweave.plans.workspace import Workspace

try:  # the standard library's parser of regular expressions
    from re import _parser as sre
except ImportError:  # pragma: no cover
    import sre_parse as sre

#: As many strings as an exact set of alternatives may hold.
_MOST_STRINGS = 16
#: About as many distinct texts are in a block of the index.
BLOCK_TEXTS = 4096
#: Matches whose lengths are added up beforehand.
_LEVEL = 64


@dataclass(frozen=True)
class Rule:
    """pattern: without capturing groups but the counted one; least: its smallest length in characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


# The base rules, then rules for common key formats.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", r"[0-9a-f]{32,}", 32, 0, True),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("vcs_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)


def trigram_query(pattern: str):
    """``("and", parts)``, ``("or", parts)``, a trigram, or None where nothing is mandatory."""
    return _query(list(sre.parse(pattern)))


def _exact(node) -> set[str] | None:
    """All strings that a node matches, in lower case, if they are few."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "SUBPATTERN":
        return _exact_sequence(list(arg[-1]))
    if name == "BRANCH":
        found: set[str] = set()
        for option in arg[1]:
            own = _exact_sequence(list(option))
            if own is None:
                return None
            found |= own
        return found if len(found) <= _MOST_STRINGS else None
    if name == "IN":
        if any(str(x[0]) != "LITERAL" for x in arg) or len(arg) > _MOST_STRINGS:
            return None
        return {chr(x[1]).lower() for x in arg}
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, body = arg
        if high is sre.MAXREPEAT or high > 4:
            return None
        own = _exact_sequence(list(body))
        if own is None:
            return None
        found = {"".join(p) for n in range(low, high + 1) for p in product(own, repeat=n)}
        return found if len(found) <= _MOST_STRINGS else None
    return None


def _exact_sequence(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        own = _exact(node)
        if own is None:
            return None
        found = {a + b for a in found for b in own}
        if len(found) > _MOST_STRINGS:
            return None
    return found


def _query(nodes):
    parts, run = [], {""}

    def close(strings):
        own = _strings_query(strings)
        if own is not None:
            parts.append(own)

    for node in nodes:
        own = _exact(node)
        grown = None if own is None else {a + b for a in run for b in own}
        if grown is not None and len(grown) <= _MOST_STRINGS:
            run = grown
            continue
        close(run)
        run = {""}
        if own is not None:
            run = own
            continue
        op, arg = str(node[0]), node[1]
        inner = None
        if op == "SUBPATTERN":
            inner = _query(list(arg[-1]))
        elif op == "BRANCH":
            options = [_query(list(x)) for x in arg[1]]
            inner = None if None in options else ("or", options)
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            inner = _query(list(arg[2]))
        if inner is not None:
            parts.append(inner)
    close(run)
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else ("and", parts)


def _strings_query(strings: set[str]):
    """OR over strings of the AND over their trigrams; None if one is too short."""
    options = []
    for s in sorted(strings):
        grams = sorted({s[i : i + 3] for i in range(len(s) - 2)})
        if not grams:
            return None
        options.append(grams[0] if len(grams) == 1 else ("and", grams))
    return options[0] if len(options) == 1 else ("or", options)


def _grams(query) -> set[str]:
    if query is None or isinstance(query, str):
        return set() if query is None else {query}
    return set().union(*map(_grams, query[1]))


def _key() -> Column:
    """What names a text in the index."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def build_index(docs: DataFrame, grams: list[str], work: Workspace) -> DataFrame:
    """The inverted index of ``docs (text)``: ``(block, gram, texts)``, the keys of the block's texts that hold the trigram."""
    blocks = max(1, -(-docs.count() // BLOCK_TEXTS))
    lower = docs.select(_key().alias("key"), F.lower(F.coalesce("text", F.lit(""))).alias("body"))
    held = F.array_compact(F.array(*[F.when(F.contains("body", F.lit(g)), F.lit(g)) for g in grams]))
    postings = lower.select("key", F.explode(held).alias("gram"))
    return work.save(postings.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "gram").agg(F.collect_set("key").alias("texts")), "index")


def _answer(query, lists: Column) -> Column:
    """The keys that a query gives, from a block's map from trigrams to postings."""
    if isinstance(query, str):
        return F.coalesce(lists[query], F.array().cast("array<bigint>"))
    kind, parts = query
    out = _answer(parts[0], lists)
    for p in parts[1:]:
        out = F.array_intersect(out, _answer(p, lists)) if kind == "and" else F.array_union(out, _answer(p, lists))
    return out


def candidates(docs: DataFrame, queries: list, work: Workspace) -> DataFrame:
    """``(key, mask)``: texts that the index admits for a rule, with a bit for each rule's place; rules without a query have none."""
    asked = {i: q for i, q in enumerate(queries) if q is not None}
    if not asked:
        return docs.sparkSession.createDataFrame([], "key bigint, mask int")
    index = build_index(docs, sorted(set().union(*map(_grams, asked.values()))), work)
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "texts"))).alias("lists"))

    def marked(i: int, query) -> Column:
        return F.transform(_answer(query, F.col("lists")), lambda k: F.struct(k.alias("key"), F.lit(1 << i).alias("bit")))

    found = lists.select(F.explode(F.concat(*[marked(i, q) for i, q in asked.items()])).alias("c")).select("c.*")
    return work.save(found.groupBy("key").agg(F.bit_or("bit").alias("mask")), "candidates")


def _add(a: Column, b: Column) -> Column:
    return a + b


def _let(value: Column, function) -> Column:
    """``function`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Structs ``(start, order, kind, end)`` of a rule's matches.

    Each find begins where the one before ended, so a lazy gap before the pattern gives
    the text between matches, and lengths add up to places.
    """
    anchored = rf"(?s)\G(.*?)({rule.pattern})"
    gaps = F.regexp_extract_all(text, F.lit(anchored), F.lit(1))
    hits = F.regexp_extract_all(text, F.lit(anchored), F.lit(2))
    counted = F.regexp_extract_all(text, F.lit(anchored), F.lit(2 + rule.group))
    sizes = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))
    sizes = F.zip_with(sizes, counted, lambda s, c: F.struct(s["gap"].alias("gap"), s["hit"].alias("hit"), F.length(c).alias("counted")))

    def laid(sizes: Column) -> Column:
        lengths = F.transform(sizes, lambda s: s["gap"] + s["hit"])
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(sizes)), F.lit(_LEVEL))
        return F.struct(sizes.alias("sizes"), lengths.alias("lengths"), F.transform(places, lambda i: F.aggregate(F.slice(lengths, i, _LEVEL), F.lit(0), _add)).alias("sums"))

    def placed(x: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            whole = F.floor(i / _LEVEL).cast("int")
            before = F.aggregate(F.slice(x["sums"], 1, whole), F.lit(0), _add) + F.aggregate(F.slice(x["lengths"], whole * _LEVEL + 1, i - whole * _LEVEL), F.lit(0), _add)
            start = before + s["gap"]
            span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (start + s["hit"]).alias("end"))
            return F.when(s["counted"] >= rule.least, span)

        return F.array_compact(F.transform(x["sizes"], one))

    return _let(_let(sizes, laid), placed)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, *, keep: bool = False) -> DataFrame:
    """``(row, text, found)``: the documents (``doc_id`` alone unless ``keep``) as structs, and all spans as structs ``(start, ord, kind, end)``."""
    work = Workspace(docs.sparkSession, "secrets")
    queries = [trigram_query(r.pattern) for r in rules]
    admitted = candidates(docs, queries, work)
    row = packed_row(docs) if keep else F.struct("doc_id").alias("row")
    rows = docs.select(row, F.coalesce("text", F.lit("")).alias("text"), _key().alias("key"))
    rows = rows.join(admitted, "key", "left").select("row", "text", F.coalesce("mask", F.lit(0)).alias("mask"))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    parts = []
    for i, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        passes = F.lit(True) if query is None else F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
        # a cheap test comes before the places are worked out
        parts.append(F.when(passes & F.col("text").rlike(rule.pattern), _spans(F.col("text"), rule, i)).otherwise(none))
    return rows.select("row", "text", F.array_sort(F.concat(*parts)).alias("found"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``(doc_id, n_<base kind>..., base_sha256, spans)`` for each row of ``docs``."""
    rows = with_spans(docs, rules)
    base = [r.kind for r in rules if r.base]
    counts = [F.size(F.filter("found", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in base]
    own = F.filter("found", lambda s: s["kind"].isin(base))
    return rows.select("row.doc_id", *counts, F.sha2(_joined(own).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by ``mark``; spans that touch or overlap are one.

    ``n_chars``, where there is one, follows the text.
    """
    rows = with_spans(docs, rules, keep=True)
    text, found = F.col("text"), F.col("found")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = (s["start"] > acc["at"]) | (acc["at"] == 0)
        return F.struct(F.when(fresh, F.concat(acc["parts"], F.array(gap, F.lit(mark)))).otherwise(acc["parts"]).alias("parts"), F.greatest(acc["at"], s["end"]).alias("at"))

    def some(acc: Column, spans: Column) -> Column:
        # parts are joined a few hundred at a time, so that lists stay short
        begin = F.struct(F.array().cast("array<string>").alias("parts"), acc["at"].alias("at"))
        own = F.aggregate(spans, begin, step)
        return _let(own, lambda x: F.struct(F.concat(acc["parts"], F.array(F.array_join(x["parts"], ""))).alias("parts"), x["at"].alias("at")))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    groups = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(found)), F.lit(256)), lambda i: F.slice(found, i, 256))
    clean = F.aggregate(groups, start, some, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    rows = rows.select("row", F.when(F.size(found) > 0, clean).alias("clean"))
    field = lambda c: F.col("row").getField(c)
    made = {"text": F.coalesce("clean", field("text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("clean").isNotNull(), F.length("clean").cast("bigint")).otherwise(field("n_chars"))
    return rows.select(*[made.get(c, field(c)).alias(c) for c in docs.columns])
