"""Text records of entities, and token-window chunks."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions import variants as V
from strandweave.model import PropertyGraph, has_data

FILTER_KEYS = ("source_id", "entity_id", "entity_types", "source_kind")
#: A token: a run of letters, digits and underscores, or one other visible character.
TOKEN = r"\w+|[^\w\s]"
#: Blocks of tokens that are added up beforehand.
_LEVEL = 64


def _add(a: Column, b: Column) -> Column:
    return a + b


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def property_text(types: Column, props: Column, keys: list[str] | None = None) -> Column:
    """``[types]`` and a line ``key: value`` for each property, by key; objects are left out."""
    entries = F.map_entries(F.map_filter(props, lambda k, v: ~k.startswith("_") & V.present(v) & ~F.coalesce(V.kind(v).rlike("^OBJECT"), F.lit(False))))
    if keys is not None:
        entries = F.filter(entries, lambda e: e["key"].isin(list(keys)) if keys else F.lit(False))
    plain = lambda v: F.when(
        F.try_variant_get(v, "$", "array<variant>").isNotNull(),
        F.array_join(F.transform(F.filter(V.elements(v), lambda x: ~F.coalesce(V.kind(x).rlike("^OBJECT"), F.lit(False))), V.shown), ", "),
    ).otherwise(V.shown(v))
    lines = F.transform(F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("k"), plain(e["value"]).alias("v")))), lambda e: F.concat_ws(": ", e["k"], e["v"]))
    lines = F.filter(lines, lambda x: ~x.rlike(r":\s*$"))
    head = F.when(F.size(types) > 0, F.array(F.concat(F.lit("["), F.array_join(types, ", "), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(lines) > 0, F.array_join(F.concat(head, lines), "\n"))


def apply_filters(records: DataFrame, filters: dict | None) -> DataFrame:
    """Any-of filters by key; an empty list matches nothing, None is no filter, other keys raise."""
    for key, wanted in (filters or {}).items():
        if key not in FILTER_KEYS:
            raise ValueError(f"unknown filter {key!r}; use one of {', '.join(FILTER_KEYS)}")
        if wanted is None:
            continue
        values = [wanted] if isinstance(wanted, str) else list(wanted)
        if not values:
            return records.where(F.lit(False))
        records = records.where(F.arrays_overlap("entity_types", F.array(*map(F.lit, values))) if key == "entity_types" else F.col(key).isin(values))
    return records


def text_records(
    g: PropertyGraph, *, source_kind: str = "file", text_properties=None, include_properties=None, filters: dict | None = None, files: DataFrame | None = None, store_path: str | None = None, restrict_to_view: bool = True
) -> DataFrame:
    """``(source_id, entity_id, source_kind, entity_types, text)`` and chosen properties.

    ``properties`` records hold an entity's property text, ``file`` records the text of its
    file from ``files (id, text)``; a kind in the filters goes before ``source_kind``.
    The root and blank texts give no record; an entity's property record comes first.

    With ``store_path`` the records are those of an index as it was built, with their
    ``token_count``: of the graph's entities only, or of all with ``restrict_to_view=False``;
    then chosen properties are NULL for an entity that the graph has not.
    """
    if isinstance(include_properties, str):
        raise TypeError("include_properties is a list of names or True")
    if filters and filters.get("source_kind") is not None:
        source_kind = "all"
    if source_kind not in ("file", "properties", "all"):
        raise ValueError("source_kind is 'file', 'properties' or 'all'")
    if store_path is not None:
        if files is not None or text_properties is not None:
            raise ValueError("an index has the texts that it was built with; files and text_properties are for live records")
        return _stored_records(g, store_path, source_kind, include_properties, filters, restrict_to_view)
    root = F.coalesce(F.try_variant_get(F.col("props")["_is_root"], "$", "boolean"), F.lit(False))
    own = g.entities.where(~root)
    base = [F.coalesce(base_name(F.col("source")), base_name(F.lit(g.source).cast("string")), F.lit("unknown")).alias("source_id"), F.col("id").alias("entity_id")]
    parts = []
    keep = ["types", "props", "ord"]
    if source_kind in ("properties", "all"):
        keys = None if text_properties is None else list(text_properties)
        parts.append(own.select(*base, F.lit("properties").alias("source_kind"), *keep, property_text(F.col("types"), F.col("props"), keys).alias("text")))
    if source_kind in ("file", "all") and files is not None:
        with_file = own.where(has_data()).join(files.select("id", F.col("text").alias("_text")), "id")
        parts.append(with_file.select(*base, F.lit("file").alias("source_kind"), *keep, F.col("_text").alias("text")))
    if not parts:
        parts = [own.select(*base, F.lit("file").alias("source_kind"), *keep, F.lit(None).cast("string").alias("text")).where(F.lit(False))]
    records = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    records = records.where("text IS NOT NULL AND trim(text) <> ''").withColumnRenamed("types", "entity_types")
    records = apply_filters(records, filters)
    return records.select("source_id", "entity_id", "source_kind", "entity_types", "text", *_chosen(include_properties))


def _chosen(include_properties) -> list[Column]:
    """The columns that ``include_properties`` asks for."""
    if include_properties is True:
        return [F.map_filter("props", lambda k, _: ~k.startswith("_")).alias("properties")]
    return [F.col("props")[k].alias(k) for k in include_properties or ()]


def _stored_records(g: PropertyGraph, store_path: str, source_kind: str, include_properties, filters: dict | None, restrict_to_view: bool) -> DataFrame:
    """Records of an index, joined to the graph's entities."""
    from strandweave.operators.semantic import Store

    rows = Store(g.entities.sparkSession, store_path).records(filters)
    if source_kind != "all":
        rows = rows.where(F.col("source_kind") == source_kind)
    own = g.entities.select(F.col("id").alias("entity_id"), "props")
    joined = rows.join(own, "entity_id", "inner" if restrict_to_view else "left")
    return joined.select("source_id", "entity_id", "source_kind", "entity_types", "text", token_count(F.col("text")).alias("token_count"), *_chosen(include_properties))


def _let(value: Column, function) -> Column:
    """``function`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _blocks(text: Column, tokens: int) -> Column:
    """The text cut behind every ``tokens`` tokens; white space behind the last token is left out."""
    return F.regexp_extract_all(text, F.lit(rf"\G(?:\s*+(?:\w++|[^\w\s])){{1,{tokens}}}+"), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def chunk_spans(text: Column, window: int = 300, overlap: int = 50) -> Column:
    """Array of ``(chunk_index, start, end, tokens)`` in code points, the end exclusive.

    A text of no more tokens than the window is one chunk, whole.  Otherwise windows slide
    by ``window - overlap`` tokens and begin and end with a token; the last one ends with
    the text's last token.
    """
    if not 0 <= overlap < window:
        raise ValueError("the overlap is smaller than the window")
    step = window - overlap
    # chunks begin and end where blocks of so many tokens do, and sums over blocks give their places
    unit = gcd(step, window)

    def laid(blocks: Column) -> Column:
        count = F.when(F.size(blocks) > 0, (F.size(blocks) - 1) * unit + token_count(F.element_at(blocks, -1))).otherwise(0)
        return F.struct(blocks.alias("blocks"), F.transform(blocks, F.length).alias("sizes"), count.alias("n"))

    def summed(x: Column) -> Column:
        # a second level keeps the sums short in long texts
        parts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(x["sizes"])), F.lit(_LEVEL))
        sums = F.transform(parts, lambda i: F.aggregate(F.slice(x["sizes"], i, _LEVEL), F.lit(0), _add))
        return F.struct(x["blocks"].alias("blocks"), x["sizes"].alias("sizes"), x["n"].alias("n"), sums.alias("sums"))

    def spans(x: Column) -> Column:
        n = x["n"]
        count = F.ceil((n - window) / step).cast("int") + 1

        def upto(block: Column) -> Column:
            whole = F.floor(block / _LEVEL).cast("int")
            return F.aggregate(F.slice(x["sums"], 1, whole), F.lit(0), _add) + F.aggregate(F.slice(x["sizes"], whole * _LEVEL + 1, block - whole * _LEVEL), F.lit(0), _add)

        def chunk(i: Column) -> Column:
            first, last = i * step, F.least(i * step + window, n)
            at = (first / unit).cast("int")
            start = upto(at) + F.length(F.regexp_extract(F.get(x["blocks"], at), r"^\s*", 0))
            end = upto(F.least(F.ceil(last / unit).cast("int"), F.size(x["sizes"])))
            return F.struct(i.alias("chunk_index"), start.alias("start"), end.alias("end"), (last - first).alias("tokens"))

        one = F.struct(F.lit(0).alias("chunk_index"), F.lit(0).alias("start"), F.length(text).alias("end"), n.alias("tokens"))
        none = F.array().cast("array<struct<chunk_index:int,start:int,end:int,tokens:int>>")
        return F.when(n == 0, none).when(n <= window, F.array(one)).otherwise(F.transform(F.sequence(F.lit(0), count - 1), chunk))

    return _let(_let(_let(_blocks(text, unit), laid), summed), spans)


def chunks(records: DataFrame, window: int = 300, overlap: int = 50) -> DataFrame:
    """A row for each chunk of each record, with the record's other columns."""
    others = [c for c in records.columns if c != "text"]
    spread = records.select(*others, "text", F.explode(chunk_spans(F.col("text"), window, overlap)).alias("c"))
    return spread.select(*others, "c.chunk_index", "c.start", "c.end", "c.tokens", F.expr("substring(text, c.start + 1, c.end - c.start)").alias("chunk"))
