"""CSV, GraphML, text and Parquet output.

CSV, text and Parquet are folders of part files in the graph's order, so writing stays
distributed; a GraphML document is written as parts too, which are then put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions import variants as V
from strandweave.model import PropertyGraph, primary_type
from strandweave.operators.records import EDGE_PROMOTED, ENTITY_PROMOTED, free_name, label, property_names


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def _named(frame: DataFrame, promoted: tuple[str, ...]) -> dict[str, str]:
    names, taken = {}, set(promoted)
    for key in property_names(frame):
        name = free_name(key, taken)
        names[name] = key
        taken.add(name)
    return names


def flat_nodes(g: PropertyGraph) -> DataFrame:
    """Entities as rows of cells: promoted columns, then each property flattened."""
    base = [F.col("id"), label(F.col("id"), F.col("props")).alias("label"), primary_type(F.col("types"), "").alias("type"), V.pipe_list(F.col("types")).alias("types")]
    cells = [F.coalesce(V.flat(F.col("props")[k]), F.lit("")).alias(n) for n, k in _named(g.entities, ENTITY_PROMOTED).items()]
    return g.entities.orderBy("ord").select(*base, *cells)


def flat_edges(g: PropertyGraph) -> DataFrame:
    """Relationships as rows of cells."""
    base = [F.col("src").alias("source"), F.col("dst").alias("target"), F.col("type"), F.coalesce("rel_id", F.lit("")).alias("rel_id")]
    cells = [F.coalesce(V.flat(F.col("props")[k]), F.lit("")).alias(n) for n, k in _named(g.relationships, EDGE_PROMOTED).items()]
    return g.relationships.orderBy("ord").select(*base, *cells)


def write_csv(g: PropertyGraph, path: str, overwrite: bool = False) -> None:
    """``nodes.csv`` and ``edges.csv`` below ``path``."""
    for name, rows in (("nodes.csv", flat_nodes(g)), ("edges.csv", flat_edges(g))):
        rows.write.mode(_mode(overwrite)).option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{path.rstrip('/')}/{name}")


def write_parquet(g: PropertyGraph, path: str, overwrite: bool = False) -> None:
    g.entities.write.mode(_mode(overwrite)).parquet(f"{path}/entities")
    g.relationships.write.mode(_mode(overwrite)).parquet(f"{path}/relationships")


def _xml(c: Column) -> Column:
    out = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_lines(g: PropertyGraph) -> DataFrame:
    """``(part, ord, value)``: the document's lines, in order of the first two."""
    from strandweave.plans.numbering import numbered

    nodes, edges = flat_nodes(g), flat_edges(g)
    node_keys, edge_keys = [c for c in nodes.columns if c != "id"], [c for c in edges.columns if c not in ("source", "target")]
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="n{i}" for="node" attr.name="{escape(k)}" attr.type="string"/>' for i, k in enumerate(node_keys)]
    head += [f'<key id="r{i}" for="edge" attr.name="{escape(k)}" attr.type="string"/>' for i, k in enumerate(edge_keys)]
    head.append('<graph edgedefault="directed">')
    cell = lambda p, i, k: F.when(F.col(f"`{k}`") != "", F.concat(F.lit(f'<data key="{p}{i}">'), _xml(F.col(f"`{k}`")), F.lit("</data>"))).otherwise("")
    body = lambda p, keys: F.concat(*[cell(p, i, k) for i, k in enumerate(keys)]) if keys else F.lit("")
    ordered_nodes = numbered(g.entities, "ord", "id", name="_n").select("id", F.col("_n").alias("at"))
    n = nodes.join(ordered_nodes, "id").select(F.lit(1).alias("part"), F.col("at").alias("ord"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), body("n", node_keys), F.lit("</node>")).alias("value"))
    keyed = PropertyGraph(g.entities, numbered(g.relationships, "ord", "src", "dst", name="_n").drop("ord").withColumnRenamed("_n", "ord"))
    source = keyed.relationships.orderBy("ord")
    names = _named(g.relationships, EDGE_PROMOTED)
    cells = [F.coalesce(V.flat(F.col("props")[k]), F.lit("")).alias(x) for x, k in names.items()]
    flat = source.select("ord", F.col("src").alias("source"), F.col("dst").alias("target"), "type", F.coalesce("rel_id", F.lit("")).alias("rel_id"), *cells)
    e = flat.select(F.lit(2).alias("part"), "ord", F.concat(F.lit('<edge id="e'), F.col("ord").cast("string"), F.lit('" source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('">'), body("r", edge_keys), F.lit("</edge>")).alias("value"))
    spark = g.entities.sparkSession
    rows = [(0, i, x) for i, x in enumerate(head)] + [(3, 0, "</graph>"), (3, 1, "</graphml>")]
    return spark.createDataFrame(rows, "part int, ord bigint, value string").unionByName(n.select("part", F.col("ord").cast("bigint").alias("ord"), "value")).unionByName(e.select("part", F.col("ord").cast("bigint").alias("ord"), "value"))


def write_graphml(g: PropertyGraph, path: str, overwrite: bool = False) -> None:
    """One document in one file."""
    from strandweave.plans.files import single_file

    single_file(graphml_lines(g).orderBy("part", "ord").select("value"), path, overwrite)


def write_text(g: PropertyGraph, path: str, overwrite: bool = False, separator: str = "\n\n", headers: bool = True, source_kind: str = "all", **options) -> None:
    """Text records, each below a line that says where it is from."""
    if (options.get("filters") or {}).get("source_kind") is not None:
        raise ValueError("give source_kind as an argument, not as a filter")
    from strandweave.operators.text import text_records

    one_line = lambda c: F.regexp_replace(c, r"\R", " ")
    rows = text_records(g, source_kind=source_kind, **options).orderBy("source_id", "entity_id", F.desc("source_kind"))
    head = F.concat(F.lit("=== "), one_line(F.col("source_id")), F.lit(" | "), one_line(F.col("entity_id")), F.lit(" | "), F.col("source_kind"), F.lit(" ===\n"))
    value = F.concat(head, F.col("text")) if headers else F.col("text")
    rows.select(value.alias("value")).write.mode(_mode(overwrite)).option("lineSep", separator).text(path)


def to_networkx(g: PropertyGraph):
    """A networkx multigraph on the driver; for graphs that fit there."""
    import json

    import networkx  # optional

    out = networkx.MultiDiGraph()
    for r in g.entities.select("id", "types", F.transform_values("props", lambda _, v: F.to_json(v)).alias("p")).toLocalIterator():
        out.add_node(r["id"], types=list(r["types"] or []), **{k: json.loads(v) if v else None for k, v in r["p"].items()})
    for r in g.relationships.select("src", "dst", "type", F.transform_values("props", lambda _, v: F.to_json(v)).alias("p")).toLocalIterator():
        out.add_edge(r["src"], r["dst"], key=None, type=r["type"], **{k: json.loads(v) if v else None for k, v in r["p"].items()})
    return out
