"""Graphs from tables: definitions say which columns are ids, types and ends."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.model import PropertyGraph, checked, last_wins, no_props


@dataclass(frozen=True)
class NodeTable:
    table: str
    id_col: str
    type_col: str | None = None
    fixed_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class EdgeTable:
    table: str
    source_col: str
    target_col: str
    type_col: str | None = None


@dataclass(frozen=True)
class DetailTable:
    """Rows that become a list of objects on their parent entity."""

    table: str
    parent_col: str
    property_name: str


@dataclass(frozen=True)
class FileTable:
    table: str
    parent_col: str
    path_col: str
    relationship_type: str = "hasFile"


@dataclass(frozen=True)
class Layout:
    nodes: tuple[NodeTable, ...]
    edges: tuple[EdgeTable, ...] = ()
    details: tuple[DetailTable, ...] = ()
    files: tuple[FileTable, ...] = ()


# The tables of the heritage-records export format and their key columns.
HERITAGE = Layout(
    nodes=(
        NodeTable("ENTITY", "EID", "ETYPE"), NodeTable("ARCRESOURCE", "ARCID", None, ("ArchivalResource",)), NodeTable("PUBRESOURCE", "PUBID", None, ("PublishedResource",)),
        NodeTable("DOBJECT", "DOID", None, ("DigitalObject",)), NodeTable("REPOSITORY", "REPID", None, ("Repository",)), NodeTable("FUNCTION", "FID", None, ("Function",)),
    ),
    edges=(
        EdgeTable("RELATEDENTITY", "EID", "REID", "RERELATIONSHIP"), EdgeTable("EARRSHIP", "EID", "ARCID", "RELATIONSHIP"), EdgeTable("EPRRSHIP", "EID", "PUBID", "RELATIONSHIP"),
        EdgeTable("EDORSHIP", "DOID", "EID", "RELATIONSHIP"), EdgeTable("PRREPRSHIP", "PUBID", "REPID"), EdgeTable("EFRSHIP", "EID", "FID"),
    ),
    details=(DetailTable("ENTITYNAME", "EID", "entitynames"), DetailTable("ENTITYEVENT", "EID", "entityevents")),
    files=(FileTable("DOBJECTVERSION", "DOID", "DOV"),),
)


def clean_id(c: Column) -> Column:
    """Trimmed text of an id, whole numbers without a point."""
    return F.regexp_replace(F.trim(c.cast("string")), r"^(-?\d+)\.0$", "$1")


def split_types(c: Column) -> Column:
    """``A - B C`` as ``[A, B_C]``."""
    parts = F.transform(F.split(c.cast("string"), "-"), lambda p: F.replace(F.trim(p), F.lit(" "), F.lit("_")))
    return F.filter(parts, lambda p: p != "")


def _properties(df: DataFrame, skip: set[str], table: str) -> Column:
    rest = [c for c in df.columns if c not in skip]
    pairs = [x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("variant"))]
    made = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else no_props()
    return F.map_concat(F.map_filter(made, lambda k, _: k != "source_table"), F.create_map(F.lit("source_table"), F.lit(table).cast("variant")))


def _other_than(name: str):
    return lambda k, _: k != name


def _column(df: DataFrame, name: str) -> str:
    """The table's own spelling of a column's name."""
    own = {c.lower(): c for c in df.columns}
    if name.lower() not in own:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return own[name.lower()]


def build(load: Callable[[str], DataFrame | None], layout: Layout, source: str | None = None) -> tuple[PropertyGraph, DataFrame]:
    """The graph of the layout's tables, and the edges that are dropped for a missing end.

    ``load`` gives a table by name, or None where there is none.
    """
    entities, edges = [], []
    at = lambda i: F.monotonically_increasing_id() + F.lit(i * (1 << 56))
    step = 0
    for d in layout.nodes:
        if (df := load(d.table)) is None:
            continue
        id_col = _column(df, d.id_col)
        type_col = _column(df, d.type_col) if d.type_col else None
        fixed = F.array(*map(F.lit, d.fixed_types or ("Unknown",)))
        types = F.coalesce(split_types(F.col(type_col)), fixed) if type_col else fixed
        entities.append(df.where(F.col(id_col).isNotNull()).select(clean_id(F.col(id_col)).alias("id"), at(step).alias("ord"), types.alias("types"), _properties(df, {id_col, type_col}, d.table).alias("props"), F.lit(source).cast("string").alias("source")))
        step += 1
    for f in layout.files:
        if (df := load(f.table)) is None:
            continue
        parent, path = _column(df, f.parent_col), _column(df, f.path_col)
        rows = df.where(F.col(path).isNotNull())
        name = F.trim(F.col(path).cast("string"))
        entities.append(rows.select(name.alias("id"), at(step).alias("ord"), F.array(F.lit("File")).alias("types"), _properties(df, {parent, path}, f.table).alias("props"), F.lit(source).cast("string").alias("source")))
        edges.append(rows.where(F.col(parent).isNotNull()).select(at(step).alias("ord"), clean_id(F.col(parent)).alias("src"), name.alias("dst"), F.lit(f.relationship_type).alias("type"), no_props().alias("props"), F.lit(None).cast("string").alias("rel_id")))
        step += 1
    for e in layout.edges:
        if (df := load(e.table)) is None:
            continue
        a, b = _column(df, e.source_col), _column(df, e.target_col)
        t = _column(df, e.type_col) if e.type_col else None
        kind = F.coalesce(F.nullif(F.trim(F.col(t).cast("string")), F.lit("")), F.lit(e.table)) if t else F.lit(e.table)
        edges.append(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(at(step).alias("ord"), clean_id(F.col(a)).alias("src"), clean_id(F.col(b)).alias("dst"), kind.alias("type"), _properties(df, {a, b, t}, e.table).alias("props"), F.lit(None).cast("string").alias("rel_id")))
        step += 1
    if not entities:
        raise ValueError("none of the layout's node tables was found")
    nodes = entities[0]
    for x in entities[1:]:
        nodes = nodes.unionByName(x)
    nodes = last_wins(nodes)
    for d in layout.details:
        if (df := load(d.table)) is None:
            continue
        parent = _column(df, d.parent_col)
        rest = [c for c in df.columns if c != parent]
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]))
        grouped = df.where(F.col(parent).isNotNull()).select(clean_id(F.col(parent)).alias("id"), F.monotonically_increasing_id().alias("o"), row.alias("j")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "j"))), lambda x: x["j"]).alias("js"))
        listed = F.parse_json(F.concat(F.lit("["), F.array_join("js", ","), F.lit("]")))
        nodes = nodes.join(grouped.select("id", listed.alias("detail")), "id", "left").select(
            "id", "ord", "types", F.when(F.col("detail").isNull(), F.col("props")).otherwise(F.map_concat(F.map_filter("props", _other_than(d.property_name)), F.create_map(F.lit(d.property_name), F.col("detail")))).alias("props"), "source"
        )
    spark = nodes.sparkSession
    links = spark.createDataFrame([], "ord bigint, src string, dst string, type string, props map<string,variant>, rel_id string") if not edges else edges[0]
    for x in edges[1:]:
        links = links.unionByName(x)
    kept, lost = checked(nodes, links)
    return PropertyGraph(nodes, kept, source=source), lost


def csv_loader(spark: SparkSession, path: str) -> Callable[[str], DataFrame | None]:
    """Tables by the stem of a CSV file anywhere below ``path``, in either case."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").load(path).select("path").collect()
    files = {r["path"].rpartition("/")[2].rpartition(".")[0].upper(): r["path"] for r in sorted(listed, key=lambda r: r["path"], reverse=True)}

    def load(table: str) -> DataFrame | None:
        if table.upper() not in files:
            return None
        read = lambda encoding: spark.read.csv(files[table.upper()], header=True, inferSchema=True, multiLine=True, escape='"', encoding=encoding)
        utf8 = read("UTF-8")
        odd = utf8.where(" OR ".join(f"contains(cast(`{c}` AS string), '�')" for c in utf8.columns)) if utf8.columns else utf8
        return utf8 if odd.isEmpty() else read("ISO-8859-1")

    return load


def read_csv(spark: SparkSession, path: str, layout: Layout = HERITAGE) -> PropertyGraph:
    return build(csv_loader(spark, path), layout, path)[0]
