"""JSON-LD collections: a document of items becomes entities, references become edges.

A whole document is one row until it is parsed; from then on items are rows.
"""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import variants as V
from strandweave.model import EDGE_COLUMNS, PropertyGraph, checked, last_wins, note
from strandweave.plans.numbering import numbered

DOCUMENT = "ro-crate-metadata.json"
#: Keys that are no properties.
_OWN = ("@id", "@type")
_ENDS = ("source", "target")


def decoded(id_: Column) -> Column:
    """Percent-decoded, but for full URIs and what can't be decoded."""
    plain = F.try_url_decode(F.replace(id_, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(id_, F.lit("://")), id_).otherwise(F.coalesce(plain, id_))


def _reference(v: Column) -> Column:
    """The id of an object that has nothing but ``@id``; else NULL."""
    alone = F.size(F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))) == 1
    return F.when(V.kind(v).rlike("^OBJECT") & alone, F.try_variant_get(v, "$['@id']", "string"))


def _target(v: Column) -> Column:
    """The id of any object with ``@id``."""
    return F.when(V.kind(v).rlike("^OBJECT"), F.try_variant_get(v, "$['@id']", "string"))


def _plain(v: Column) -> Column:
    """A value with references as ids, in lists too; a list of one literal is the literal."""
    items = F.try_variant_get(v, "$", "array<variant>")
    one = lambda x: F.coalesce(_reference(x).cast("variant"), x)
    literal = (F.size(items) == 1) & ~F.coalesce(V.kind(F.get(items, F.lit(0))).rlike("^(OBJECT|ARRAY|VOID)"), F.lit(False))
    listed = F.to_variant_object(F.transform(items, one))
    return F.when(items.isNull(), one(v)).when(literal, F.get(items, F.lit(0))).otherwise(listed)


def _types(v: Column) -> tuple[Column, Column]:
    """Cleaned type names, and whether the item is a relationship of its own."""
    raw = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.try_variant_get(v, "$", "string")))
    raw = F.filter(raw, lambda t: t.isNotNull())
    clean = F.filter(F.transform(raw, lambda t: F.trim(t)), lambda t: t != "")
    several = F.when(F.size(clean) > 1, F.filter(clean, lambda t: t != "Relationship")).otherwise(clean)
    return F.when(F.size(several) > 0, several).otherwise(F.array(F.lit("Unknown"))), F.array_contains(raw, "Relationship")


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, ord, item)``: the items of each document, in order."""
    docs = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("doc"))
    docs.createOrReplaceTempView("_jsonld_documents")
    out = spark.sql("SELECT d.path, e.pos AS ord, e.value AS item FROM _jsonld_documents d, LATERAL variant_explode(d.doc:['@graph']) e")
    spark.catalog.dropTempView("_jsonld_documents")
    return out


def read(spark: SparkSession, path: str, *, inline_relations: bool | list[str] = True, include_root: bool = True) -> PropertyGraph:
    """The graph of one collection, a document or the folder that holds it."""
    if not isinstance(inline_relations, (bool, list)) or isinstance(inline_relations, list) and not all(isinstance(x, str) for x in inline_relations):
        raise TypeError("inline_relations is a boolean or a list of names")
    file = path if path.endswith(".json") else f"{path.rstrip('/')}/{DOCUMENT}"
    folder = file.rpartition("/")[0]
    found = read_documents(spark, [file]).select("ord", "item", F.try_variant_get("item", "$['@id']", "string").alias("raw_id"))
    items = found.where("raw_id IS NOT NULL")
    types, reified = _types(F.try_variant_get("item", "$['@type']", "variant"))
    items = items.select("ord", "item", "raw_id", decoded(F.col("raw_id")).alias("id"), types.alias("types"), F.coalesce(reified, F.lit(False)).alias("reified")).cache()
    nameless = found.where("raw_id IS NULL").count()
    if nameless:
        note(f"{nameless} items without an id are left out")
    descriptor = items.where(F.col("raw_id") == DOCUMENT).select(F.to_json(F.try_variant_get("item", "$.about", "variant"))).first()
    root_id = _root_id(descriptor[0] if descriptor else None)
    root_item = items.where(F.col("id") == root_id).select(F.to_json("item")).first()
    metadata = {k: v for k, v in json.loads(root_item[0]).items() if k not in _OWN} if root_item else {}
    metadata["_root_id"] = root_id
    fields = F.from_json(F.to_json("item"), "map<string,variant>")
    marked = F.when(F.col("id") == root_id, F.map_concat(F.col("f"), F.create_map(F.lit("_is_root"), F.lit(True).cast("variant")))).otherwise(F.col("f"))
    props = F.transform_values(F.map_filter(fields, lambda k, _: ~k.isin(*_OWN)), lambda _, v: _plain(v))
    entities = items.where(~F.col("reified")).withColumn("f", props).select("id", "ord", "types", marked.alias("props"), F.lit(folder).alias("source"))
    entities = last_wins(entities)
    # numbered by item, property and place in its list, none of which has a bound
    edges = numbered(_inline(items, inline_relations, entities).unionByName(_reified(items)), "item", "place", "element", name="ord").select(*EDGE_COLUMNS)
    if not include_root:
        entities = entities.where(F.col("id") != root_id)
    edges, _ = checked(entities, edges)
    return PropertyGraph(entities, edges, metadata=metadata, source=folder)


def _root_id(about: str | None) -> str:
    found = json.loads(about) if about else None
    if isinstance(found, list):
        found = found[0] if found else None
    if isinstance(found, dict):
        found = found.get("@id")
    if not isinstance(found, str):
        return "./"
    return found if "://" in found else unquote(found)


def _inline(items: DataFrame, inline_relations, entities: DataFrame) -> DataFrame:
    """An edge for each reference to a known item."""
    fields = F.from_json(F.to_json("item"), "map<string,variant>")
    pairs = items.select("ord", F.col("id").alias("src"), F.posexplode(fields).alias("p", "type", "v")).where(~F.col("type").isin(*_OWN, *_ENDS))
    if inline_relations is False:
        pairs = pairs.where(F.lit(False))
    elif inline_relations is not True:
        pairs = pairs.where(F.col("type").isin(inline_relations))
    refs = pairs.select("ord", "src", "type", "p", F.posexplode(V.elements(F.col("v"))).alias("i", "x"))
    refs = refs.select(F.col("ord").alias("item"), F.col("p").alias("place"), F.col("i").alias("element"), "src", decoded(_target(F.col("x"))).alias("dst"), "type").where("dst IS NOT NULL")
    known = refs.join(entities.select(F.col("id").alias("dst")), "dst", "left_semi")
    return known.select("item", "place", "element", "src", "dst", "type", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")).alias("props"), F.lit(None).cast("string").alias("rel_id"))


def _reified(items: DataFrame) -> DataFrame:
    """An edge for each relationship item with both ends; its other keys are properties."""
    end = lambda k: F.coalesce(_target(F.try_variant_get("item", f"$.{k}", "variant")), F.when(V.kind(F.try_variant_get("item", f"$.{k}", "variant")) == "STRING", F.try_variant_get("item", f"$.{k}", "string")))
    fields = F.from_json(F.to_json("item"), "map<string,variant>")
    props = F.transform_values(F.map_filter(fields, lambda k, _: ~k.isin(*_OWN, *_ENDS)), lambda _, v: _plain(v))
    own = items.where("reified").select(F.col("ord").alias("item"), F.lit(0).alias("place"), F.lit(0).alias("element"), decoded(end("source")).alias("src"), decoded(end("target")).alias("dst"), F.array_join("types", ", ").alias("type"), props.alias("props"), F.col("raw_id").alias("rel_id"))
    lost = own.where("src IS NULL OR dst IS NULL").count()
    if lost:
        note(f"{lost} relationship items lack an end and are left out")
    return own.where("src IS NOT NULL AND dst IS NOT NULL")


def union(graphs: dict[str, PropertyGraph]) -> PropertyGraph:
    """Several collections as one: ids get their collection's name in front, the old one is ``raw_id``."""
    entities = edges = None
    for i, (name, g) in enumerate(graphs.items()):
        prefix = lambda c, name=name: F.concat_ws("/", F.lit(name), c)
        base = F.lit(i * (1 << 52))
        raw = F.create_map(F.lit("raw_id"), F.col("id").cast("variant"))
        e = g.entities.select(prefix(F.col("id")).alias("id"), (F.col("ord") + base).alias("ord"), "types", F.map_concat(F.map_filter("props", lambda k, _: k != "raw_id"), raw).alias("props"), "source")
        r = g.relationships.select((F.col("ord") + base).alias("ord"), prefix(F.col("src")).alias("src"), prefix(F.col("dst")).alias("dst"), "type", "props", "rel_id")
        entities, edges = (e, r) if entities is None else (entities.unionByName(e), edges.unionByName(r))
    return PropertyGraph(entities, edges, metadata={n: g.metadata for n, g in graphs.items()})


def restore_root(g: PropertyGraph) -> PropertyGraph:
    """The graph with its root entity again, made from the metadata."""
    spark = g.entities.sparkSession
    own = g.metadata if "_root_id" in g.metadata else None
    roots = [(own["_root_id"], own)] if own else [(f"{n}/{m['_root_id']}", m) for n, m in g.metadata.items() if isinstance(m, dict) and "_root_id" in m]
    rows = [(i, -1, ["Dataset"], json.dumps({k: v for k, v in m.items() if k != "_root_id"} | {"_is_root": True})) for i, m in roots]
    made = spark.createDataFrame(rows, "id string, ord bigint, types array<string>, j string").select("id", "ord", "types", F.from_json("j", "map<string,variant>").alias("props"), F.lit(g.source).cast("string").alias("source"))
    made = made.join(g.entities.select("id"), "id", "left_anti")
    return PropertyGraph(made.unionByName(g.entities), g.relationships, metadata=g.metadata, source=g.source)


def read_many(spark: SparkSession, paths: list[str], *, inline_relations=True, include_root: bool = False) -> PropertyGraph:
    """One collection as it is, several as their union by folder name."""
    graphs = {}
    for p in paths:
        folder = (p.rpartition("/")[0] if p.endswith(".json") else p).rstrip("/")
        name = folder.rpartition("/")[2]
        if name in graphs:
            raise ValueError(f"two collections are named {name!r}")
        graphs[name] = read(spark, p, inline_relations=inline_relations, include_root=include_root)
    return next(iter(graphs.values())) if len(graphs) == 1 else union(graphs)

