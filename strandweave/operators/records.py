"""Record export and value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions import variants as V
from strandweave.model import PropertyGraph, primary_type

ENTITY_PROMOTED = ("id", "label", "type", "types")
EDGE_PROMOTED = ("source", "target", "type", "rel_id")


def free_name(key: str, taken: set[str]) -> str:
    """``key`` with ``prop_`` in front until it is not taken."""
    while key in taken:
        key = f"prop_{key}"
    return key


def label(id_: Column, props: Column) -> Column:
    """A name to show: a name or title that is text, else either as text, else the id."""
    own = lambda k: F.when((V.kind(props[k]) == "STRING") & (F.trim(V.text_of(props[k])) != ""), V.text_of(props[k]))
    other = lambda k: F.when(V.present(props[k]), V.shown(props[k]))
    return F.coalesce(own("name"), own("title"), other("name"), other("title"), id_)


def property_names(frame: DataFrame) -> list[str]:
    """All property keys, sorted; the set of keys is a schema and stays small."""
    return sorted(r[0] for r in frame.select(F.explode(F.map_keys("props"))).distinct().collect())


def _records(frame: DataFrame, promoted: dict[str, Column], columns) -> DataFrame:
    names = {}
    taken = set(promoted)
    if columns is None:
        for key in property_names(frame):
            names[free_name(key, taken)] = key
            taken.add(free_name(key, taken))
        wanted = [*promoted, *names]
    else:
        wanted = list(columns)
        for c in wanted:
            if c not in promoted:
                names[c] = c.removeprefix("prop_") if c.removeprefix("prop_") in promoted else c
    ordered = frame.orderBy("ord")
    return ordered.select(*[(promoted[c] if c in promoted else F.col("props")[names[c]]).alias(c) for c in wanted])


def entity_records(g: PropertyGraph, columns=None) -> DataFrame:
    """One row for each entity in order: ``id, label, type, types`` and a column for each property.

    A property whose name is taken gets ``prop_`` in front.  With ``columns`` just those,
    null where an entity lacks one.
    """
    promoted = {"id": F.col("id"), "label": label(F.col("id"), F.col("props")), "type": primary_type(F.col("types"), ""), "types": F.col("types")}
    return _records(g.entities, promoted, columns)


def relationship_records(g: PropertyGraph, columns=None) -> DataFrame:
    """One row for each relationship in order: ``source, target, type, rel_id`` and its properties."""
    promoted = {"source": F.col("src"), "target": F.col("dst"), "type": F.col("type"), "rel_id": F.col("rel_id")}
    return _records(g.relationships, promoted, columns)


def _counts(frame: DataFrame, promoted: dict[str, Column], name: str) -> DataFrame:
    count = "n" if name == "count" else "count"
    if name in promoted:
        value = promoted[name]
        items = frame.select(F.explode(value).alias("v") if name == "types" else value.alias("v")).where("v IS NOT NULL")
        return items.groupBy(F.col("v").alias(name)).agg(F.count("*").alias(count)).orderBy(F.desc(count), name)
    key = name.removeprefix("prop_") if name.removeprefix("prop_") in promoted else name
    items = frame.select(F.explode(V.elements(F.col("props")[key])).alias("v"))
    # variants can't be grouped: the kind and the JSON text stand for one
    tag = F.when(V.kind(F.col("v")).rlike("^(OBJECT|ARRAY)"), "structure").when(V.kind(F.col("v")) == "STRING", "text").when(V.kind(F.col("v")) == "BOOLEAN", "truth").otherwise("number")
    grouped = items.groupBy(tag.alias("tag"), F.to_json("v").alias("json")).agg(F.first("v").alias("value"), F.count("*").alias(count))
    return grouped.withColumn("shown", V.shown(F.col("value"))).orderBy(F.desc(count), "shown", "tag").select(F.col("value").alias(name), count)


def entity_counts(g: PropertyGraph, name: str) -> DataFrame:
    """``(name, count)`` by value of a record column, lists taken apart, the most frequent first."""
    promoted = {"id": F.col("id"), "label": label(F.col("id"), F.col("props")), "type": primary_type(F.col("types"), ""), "types": F.col("types")}
    return _counts(g.entities, promoted, name)


def relationship_counts(g: PropertyGraph, name: str) -> DataFrame:
    """``(name, count)`` by value of a relationship's record column."""
    promoted = {"source": F.col("src"), "target": F.col("dst"), "type": F.col("type"), "rel_id": F.col("rel_id")}
    return _counts(g.relationships, promoted, name)
