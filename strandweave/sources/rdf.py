"""RDF files: triples become entities, their literals properties, links relationships.

N-Triples are read line by line by expressions.  Turtle and RDF/XML are parsed by file, in
batches on the executors, into the same triples.  Subjects are in sorted order.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.model import PropertyGraph, no_props, note
from strandweave.sources import _names, rdfxml

# Vocabulary terms.
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
LABELS = ("http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2004/02/skos/core#prefLabel", "http://purl.org/dc/terms/title", "http://purl.org/dc/elements/1.1/title", "http://xmlns.com/foaf/0.1/name", "http://schema.org/name", "https://schema.org/name")
INTEGERS = ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
REALS = ("decimal", "double", "float")
TRIPLE = "s string, p string, o string, kind string, lang string, datatype string"


def read_ntriples(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Triples of N-Triples lines; ``kind`` is uri, blank or literal."""
    line = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:[^\s.]+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.'
    rows = spark.read.text(paths).where(F.col("value").rlike(line))
    part = lambda i: F.regexp_extract("value", line, i)
    some = lambda i: F.nullif(part(i), F.lit(""))
    text = part(5)
    for a, b in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    kind = F.when(some(3).isNotNull(), "uri").when(some(4).isNotNull(), "blank").otherwise("literal")
    return rows.select(F.regexp_replace(part(1), "^<|>$", "").alias("s"), part(2).alias("p"), F.coalesce(some(3), some(4), text).alias("o"), kind.alias("kind"), some(6).alias("lang"), some(7).alias("datatype"))


_TURTLE = re.compile(
    r'''\s*(?:\#[^\n]*|(?P<iri><[^>]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<num>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?))|(?P<blank>_:[\w.-]*\w)|(?P<name>(?:[\w-]+(?:\.[\w-]+)*)?:(?:[\w%-]+(?:\.[\w%-]+)*)?|[A-Za-z]+)|(?P<op>\^\^|[;,.\[\]()]))'''
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(s: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), s, flags=re.S)


def parse_turtle(text: str, scope: str = "b") -> tuple[list[tuple], dict[str, str]]:
    """Triples ``(s, p, o, kind, lang, datatype)`` and the prefixes of a Turtle text."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TURTLE.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"unexpected Turtle text: {text[at:at + 30]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
    prefixes: dict[str, str] = {}
    triples, base, i, fresh = [], "", 0, 0

    def peek(*ops):
        return i < len(tokens) and tokens[i][0] == "op" and tokens[i][1] in ops

    def take():
        nonlocal i
        i += 1
        if i > len(tokens):
            raise ValueError("the Turtle text ends in a statement")
        return tokens[i - 1]

    def iri(kind, value):
        if kind == "iri":
            inner = value[1:-1]
            return inner if re.match(r"[A-Za-z][\w+.-]*:", inner) else base + inner
        if value == "a":
            return TYPE
        prefix, _, local = value.partition(":")
        if prefix not in prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return prefixes[prefix] + local

    def blank():
        nonlocal fresh
        fresh += 1
        return f"_:{scope}{fresh}"

    def node():
        kind, value = take()
        if kind == "op" and value == "[":
            own = blank()
            if not peek("]"):
                predicates(own)
            take()
            return own, "blank", None, None
        if kind == "op" and value == "(":
            rdf = TYPE[: -len("type")]
            items = []
            while not peek(")"):
                items.append(node())
            take()
            cells = [blank() for _ in items]
            for n, (cell, item) in enumerate(zip(cells, items, strict=True)):
                triples.append((cell, rdf + "first", *item))
                triples.append((cell, rdf + "rest", *((cells[n + 1], "blank", None, None) if n + 1 < len(cells) else (rdf + "nil", "uri", None, None))))
            return (cells[0], "blank", None, None) if cells else (rdf + "nil", "uri", None, None)
        if kind == "blank":
            return value, "blank", None, None
        if kind in ("str", "long"):
            body = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            if i < len(tokens) and tokens[i][0] == "lang":
                return body, "literal", take()[1][1:], None
            if peek("^^"):
                take()
                return body, "literal", None, iri(*take())
            return body, "literal", None, None
        if kind == "num":
            return value, "literal", None, XSD + ("integer" if re.fullmatch(r"[+-]?\d+", value) else "double" if "e" in value.lower() else "decimal")
        if kind == "name" and value in ("true", "false"):
            return value, "literal", None, XSD + "boolean"
        return iri(kind, value), "uri", None, None

    def predicates(subject):
        while True:
            predicate = iri(*take())
            while True:
                triples.append((subject, predicate, *node()))
                if not peek(","):
                    break
                take()
            while peek(";"):
                take()
            if peek(".", "]") or i >= len(tokens):
                return

    while i < len(tokens):
        kind, value = tokens[i]
        word = value.lower().lstrip("@")
        if kind in ("lang", "name") and word in ("prefix", "base"):
            take()
            if word == "prefix":
                name = take()[1].rstrip(":")
                prefixes[name] = iri(*take())
            else:
                base = take()[1][1:-1]
            if peek("."):
                take()
            continue
        subject = node()[0]
        if not peek("."):
            predicates(subject)
        if not peek("."):
            raise ValueError("a Turtle statement ends with a full stop")
        take()
    return triples, prefixes


def read_parsed(spark: SparkSession, paths: list[str], parse=parse_turtle) -> tuple[DataFrame, dict[str, str]]:
    """Triples of files that are parsed whole, and their prefixes."""

    def run(batches):
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, prefixes = parse(text, re.sub(r"\W", "", path.rpartition("/")[2]))
                rows = found + [(None, k, v, "prefix", None, None) for k, v in prefixes.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(6)], names=["s", "p", "o", "kind", "lang", "datatype"])

    rows = spark.read.text(paths, wholetext=True).select("_metadata.file_path", "value").mapInArrow(run, TRIPLE)
    prefixes = {r["p"]: r["o"] for r in rows.where("kind = 'prefix'").select("p", "o").distinct().collect()}
    return rows.where("kind <> 'prefix'"), prefixes


def curie(uri, prefixes: dict[str, str]):
    """A short name by the longest namespace that fits, where anything is left of the name."""
    ranked = sorted(((len(ns), name, ns) for name, ns in prefixes.items() if name), reverse=True)
    out = uri
    for n, name, ns in reversed(ranked):
        out = F.when(F.startswith(uri, F.lit(ns)) & (F.length(uri) > n), F.concat(F.lit(f"{name}:"), F.substring(uri, n + 1, 1 << 20))).otherwise(out)
    return out


def build(triples: DataFrame, prefixes: dict[str, str], source: str | None = None, *, label_predicates=LABELS, exclude_predicates=(), include_dangling_targets: bool = False) -> PropertyGraph:
    """The graph of a set of triples."""
    t = triples.distinct()
    local = F.substring(F.col("datatype"), len(XSD) + 1, 100)
    typed = F.startswith("datatype", F.lit(XSD))
    value = (
        F.when(F.col("lang").isNotNull(), F.to_variant_object(F.struct(F.col("o").alias("value"), F.col("lang").alias("lang"))))
        .when(typed & local.isin(*INTEGERS), F.coalesce(F.col("o").try_cast("bigint").cast("variant"), F.col("o").cast("variant")))
        .when(typed & local.isin(*REALS), F.coalesce(F.col("o").try_cast("double").cast("variant"), F.col("o").cast("variant")))
        .when(typed & (local == "boolean"), F.col("o").isin("true", "1").cast("variant"))
        .when(F.col("datatype").isNull() | (F.col("datatype") == XSD + "string"), F.col("o").cast("variant"))
        .otherwise(F.to_variant_object(F.struct(F.col("o").alias("value"), F.col("datatype").alias("datatype"))))
    )
    p = curie(F.col("p"), prefixes)
    allowed = ~F.col("p").isin(*exclude_predicates) if exclude_predicates else F.lit(True)
    literals = t.where((F.col("kind") == "literal") & allowed).select("s", p.alias("k"), F.struct("o", "lang", "datatype").alias("by"), F.to_json(value).alias("j"))
    listed = literals.groupBy("s", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("by", "j"))), lambda x: x["j"]).alias("js"))
    one = F.when(F.size("js") == 1, F.parse_json(F.get("js", F.lit(0)))).otherwise(F.parse_json(F.concat(F.lit("["), F.array_join("js", ","), F.lit("]"))))
    props = listed.groupBy(F.col("s").alias("id")).agg(F.transform_values(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k"), F.to_json(one).alias("v"))))), lambda _, v: F.parse_json(v)).alias("props"))
    rank = F.array_position(F.array(*map(F.lit, label_predicates)), F.col("p"))
    tag = F.when(F.col("lang").isNull(), 0).when(F.col("lang") == "en", 1).otherwise(2)
    names = t.where((F.col("kind") == "literal") & (rank > 0)).groupBy(F.col("s").alias("id")).agg(F.min(F.struct(rank.alias("r"), tag.alias("t"), "lang", "o")).alias("l")).select("id", F.col("l.o").alias("label"))
    types = t.where(F.col("p") == TYPE).groupBy(F.col("s").alias("id")).agg(F.array_sort(F.collect_set(curie(F.col("o"), prefixes))).alias("types"))
    subjects = t.select(F.col("s").alias("id")).distinct()
    empty = F.array().cast("array<string>")
    named = F.when(F.col("label").isNotNull(), F.map_concat(F.map_filter(F.coalesce("props", no_props()), lambda k, _: k != "name"), F.create_map(F.lit("name"), F.col("label").cast("variant")))).otherwise(F.coalesce("props", no_props()))
    entities = subjects.join(types, "id", "left").join(props, "id", "left").join(names, "id", "left").select("id", F.lit(0).cast("bigint").alias("ord"), F.coalesce("types", empty).alias("types"), named.alias("props"), F.lit(source).cast("string").alias("source"))
    links = t.where(F.col("kind").isin("uri", "blank") & (F.col("p") != TYPE) & allowed).select(F.lit(0).cast("bigint").alias("ord"), F.col("s").alias("src"), F.col("o").alias("dst"), p.alias("type"), no_props().alias("props"), F.lit(None).cast("string").alias("rel_id"))
    dangling = links.join(subjects.select(F.col("id").alias("dst")), "dst", "left_anti")
    metadata: dict = {"namespaces": prefixes}
    if include_dangling_targets:
        stubs = dangling.select(F.col("dst").alias("id")).distinct().select("id", F.lit(0).cast("bigint").alias("ord"), empty.alias("types"), F.create_map(F.lit("_external"), F.lit(True).cast("variant")).alias("props"), F.lit(source).cast("string").alias("source"))
        entities = entities.unionByName(stubs)
    else:
        lost = dangling.agg(F.count("*"), F.count_distinct("dst")).first()
        if lost[0]:
            metadata["dropped_dangling_count"] = lost[0]
            note(f"{lost[0]} relationships to {lost[1]} undefined targets are left out")
        links = links.join(subjects.select(F.col("id").alias("dst")), "dst", "left_semi")
    from strandweave.plans.numbering import numbered

    entities = numbered(entities.drop("ord"), "id", name="ord").select("id", "ord", "types", "props", "source")
    links = numbered(links.drop("ord"), "src", "type", "dst", name="ord").select("ord", "src", "dst", "type", "props", "rel_id")
    return PropertyGraph(entities, links, metadata=metadata, source=source)


def read(spark: SparkSession, path: str, **options) -> PropertyGraph:
    """The graph of an RDF file or of all in a folder."""
    names = _names(spark, path)
    single = len(names) == 1 and path.rstrip("/").endswith(names[0])
    files = [path] if single else [f"{path.rstrip('/')}/{n}" for n in names]
    lines, turtle = [f for f in files if f.lower().endswith(".nt")], [f for f in files if f.lower().endswith((".ttl", ".turtle"))]
    prefixes: dict[str, str] = {}
    parts = []
    if lines:
        parts.append(read_ntriples(spark, lines))
    for chosen, parse in ((turtle, parse_turtle), ([f for f in files if f.lower().endswith((".rdf", ".owl"))], rdfxml.parse)):
        if chosen:
            rows, found = read_parsed(spark, chosen, parse)
            prefixes = found | prefixes
            parts.append(rows)
    if not parts:
        raise ValueError(f"no N-Triples, Turtle or RDF/XML file at {path}")
    return build(reduce(DataFrame.unionByName, parts), prefixes, path, **options)
