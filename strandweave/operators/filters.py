"""Structural and property filters.  Each gives the graph induced by the entities it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import temporal
from strandweave.functions import variants as V
from strandweave.model import EDGE_COLUMNS, ENTITY_COLUMNS, PropertyGraph, among, edges_between, without
from strandweave.plans.workspace import Workspace


def _names(value) -> list[str] | None:
    return None if value is None else [value] if isinstance(value, str) else list(value)


def _any_type(names: list[str]):
    return F.arrays_overlap("types", F.array(*[F.lit(n) for n in names]).cast("array<string>"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()


def select(g: PropertyGraph, *, entity_types=None, relationship_types=None, time_range=None, min_connections=None, max_connections=None, source=None, id=None) -> PropertyGraph:
    """Entities that meet all given conditions, and every relationship among them.

    Relationship types choose entities that touch such an edge; degrees count distinct
    neighbours in ``g`` itself.  Unknown types raise; an unknown id gives an empty graph.
    """
    kept, column_only = g.entities, True
    if id is not None:
        kept = kept.where(F.col("id") == id)
    if (names := _names(entity_types)) is not None:
        for n in names:
            g.types.validate(n)
        kept = kept.where(_any_type(names))
    if source is not None:
        kept = kept.where(F.contains("source", F.lit(source)))
    if time_range is not None:
        kept = kept.where(temporal.in_time_range(F.col("props"), *time_range))
    if min_connections is not None or max_connections is not None:
        counted = g.neighbours().groupBy("id").agg(F.count("*").alias("degree"))
        degree = F.coalesce("degree", F.lit(0))
        kept = kept.join(counted, "id", "left").where((degree >= (min_connections or 0)) & (degree <= (max_connections if max_connections is not None else 2**62)))
        column_only = False
    if (names := _names(relationship_types)) is not None:
        for n in names:
            g.relationship_types.validate(n)
        kept = among(kept, endpoints(g.relationships.where(F.col("type").isin(names))), "id")
        column_only = False
    kept = kept.select(*ENTITY_COLUMNS)
    unchanged = column_only and kept is g.entities
    return g.derive(kept, g.relationships if unchanged else edges_between(g.relationships, kept))


def exclude(g: PropertyGraph, *, entity_types=None, relationship_types=None, drop_isolated: bool = True) -> PropertyGraph:
    """Without matching entities and relationships, nor entities that became isolated by it."""
    kept, edges = g.entities, g.relationships
    if (names := _names(entity_types)) is not None:
        for n in names:
            g.types.validate(n)
        kept = kept.where(~F.coalesce(_any_type(names), F.lit(False)))
    if (names := _names(relationship_types)) is not None:
        for n in names:
            g.relationship_types.validate(n)
        edges = edges.where(~F.col("type").isin(names))
    edges = edges_between(edges, kept)
    if drop_isolated:
        before = endpoints(g.relationships).withColumn("before", F.lit(True))
        after = endpoints(edges).withColumn("after", F.lit(True))
        kept = kept.join(before, "id", "left").join(after, "id", "left").where("after IS NOT NULL OR before IS NULL").select(*ENTITY_COLUMNS)
    return g.derive(kept, edges)


def drop(g: PropertyGraph, values, property: str | None = None) -> PropertyGraph:
    """Without entities of which a property, or the one named, has or contains a value."""
    if not isinstance(values, (str, list, tuple, set)):
        raise TypeError("values is a string or a list")
    wanted = [values] if isinstance(values, str) else list(values)
    match = lambda v: F.coalesce(V.any_equals(v, wanted), F.lit(False))
    hit = match(F.col("props")[property]) if property is not None else F.exists(F.map_values("props"), match)
    return g.filter_entities(~hit)


def subtract(g: PropertyGraph, other: PropertyGraph) -> PropertyGraph:
    """Without the other graph's entities, by id."""
    kept = without(g.entities, other.entities.select("id"), "id")
    return g.derive(kept, edges_between(g.relationships, kept))


def where(g: PropertyGraph, **conditions) -> PropertyGraph:
    """Entities whose properties equal values, or lie in inclusive ``(low, high)`` ranges.

    Equality keeps text and numbers apart; ranges read text as numbers.  A list matches
    by any element or as a whole; a null never matches.
    """
    out = F.lit(True)
    for key, expected in conditions.items():
        v = F.col("props")[key]
        if isinstance(expected, tuple) and len(expected) == 2:
            low, high = expected
            if not all(isinstance(x, (int, float)) for x in expected):
                test = F.lit(False)
            else:
                test = F.exists(V.elements(v), _between(float(low), float(high)))
        elif expected is None:
            test = F.lit(False)
        elif isinstance(expected, (list, dict)):
            test = V.equals(v, expected) | F.exists(V.elements(v), _equal(expected))
        else:
            test = F.exists(V.elements(v), _equal(expected))
        out = out & V.present(v) & F.coalesce(test, F.lit(False))
    return g.filter_entities(out)


def _between(low: float, high: float):
    return lambda x: F.coalesce(V.number_of(x).between(low, high), F.lit(False))


def _equal(expected):
    return lambda x: F.coalesce(V.equals(x, expected), F.lit(False))


def expand(g: PropertyGraph, depth: int = 1, entity_types=None, via=None) -> PropertyGraph:
    """The selection and what lies within ``depth`` steps of it in the root graph.

    ``via`` limits the edges that are walked and ``entity_types`` what is newly reached;
    neither is validated.  Each step goes on from all entities kept so far.
    """
    root = g.root
    walked = root.relationships.where(F.col("type").isin(_names(via))) if via is not None else root.relationships
    ends = walked.select("src", "dst")
    pairs = ends.toDF("id", "nbr").unionAll(ends.select("dst", "src").toDF("id", "nbr")).distinct()
    allowed = root.entities.select("id", "types")
    if entity_types is not None:
        allowed = allowed.where(_any_type(_names(entity_types)))
    reachable = among(pairs, allowed.select("id"), "nbr") if entity_types is not None else among(pairs, root.entities.select("id"), "nbr")
    kept = g.entities.select("id")
    work = Workspace(kept.sparkSession, "expand") if depth > 1 else None
    for _ in range(depth):
        kept = kept.unionAll(among(reachable, kept, "id").select(F.col("nbr").alias("id"))).distinct()
        # each step reads the one before twice: more steps would double the plan each
        kept = work.save(kept, "kept") if work else kept
    entities = among(root.entities, kept, "id")
    return g.derive(entities, edges_between(root.relationships, entities))


def pattern(g: PropertyGraph, from_type=None, via=None, to_type=None) -> PropertyGraph:
    """The ends of edges that match the types, and every relationship among them."""
    for n in [x for x in (from_type, to_type) if x is not None]:
        g.types.validate(n)
    edges = g.relationships
    if via is not None:
        for n in _names(via):
            g.relationship_types.validate(n)
        edges = edges.where(F.col("type").isin(_names(via)))
    for end, name in (("src", from_type), ("dst", to_type)):
        known = g.entities if name is None else g.entities.where(F.array_contains("types", name))
        edges = among(edges, known.select("id"), end)
    return g.induce(endpoints(edges.select(*EDGE_COLUMNS)))
