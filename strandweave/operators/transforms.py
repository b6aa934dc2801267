"""Operators that build new graphs: merging, collapsing, peeling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions import variants as V
from strandweave.model import EDGE_COLUMNS, ENTITY_COLUMNS, PropertyGraph, among, edges_between, note, primary_type, props, shown_type, without
from strandweave.plans.workspace import Workspace


def _fresh(g: PropertyGraph, entities: DataFrame, edges: DataFrame, **kw) -> PropertyGraph:
    """A graph that is its own root."""
    return PropertyGraph(entities.select(*ENTITY_COLUMNS), edges.select(*EDGE_COLUMNS), metadata=dict(g.metadata), source=g.source, **kw)


def _merged(g: PropertyGraph, group: Column, by: str, keep_type: bool, edge_type: Column) -> PropertyGraph:
    members = g.entities.select("id", "ord", group.alias("g"))
    nodes = members.groupBy("g").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    kind = F.array("g") if keep_type else F.array(F.lit("MergedGroup"))
    entities = nodes.select(F.col("g").alias("id"), "ord", kind.alias("types"), props(label=F.col("g"), count=F.col("n"), merged_by=F.lit(by)).alias("props"), F.lit(None).cast("string").alias("source"))
    ids = members.select("id", "g")
    lifted = g.relationships.join(ids.toDF("src", "sg"), "src").join(ids.toDF("dst", "dg"), "dst").where("sg != dg")
    edges = lifted.groupBy("sg", "dg", edge_type.alias("t")).agg(F.count("*").alias("w"), F.min("ord").alias("ord"))
    edges = edges.select("ord", F.col("sg").alias("src"), F.col("dg").alias("dst"), F.col("t").alias("type"), props(weight=F.col("w")).alias("props"), F.lit(None).cast("string").alias("rel_id"))
    return _fresh(g, entities, edges)


def merge_nodes(g: PropertyGraph, by: str) -> PropertyGraph:
    """One entity for each value of a property, or each type; edges between groups with their weight.

    Entities without the property form the group ``(no value)``; edges inside a group go.
    """
    if by == "type":
        return _merged(g, shown_type(F.col("types")), by, True, F.col("type"))
    v = F.col("props")[by]
    return _merged(g, F.when(V.present(v), V.shown(v)).otherwise("(no value)"), by, False, F.col("type"))


def merge_by_primary_type(g: PropertyGraph) -> PropertyGraph:
    """One entity for each first type; one edge for each ordered pair of them."""
    return _merged(g, primary_type(F.col("types")), "type", True, F.lit("merged"))


def collapse_edges(g: PropertyGraph) -> PropertyGraph:
    """One edge for each pair of entities; a single edge stays as it is.

    Several become one with ``count``, sorted ``types``, ``bidirectional`` and the summed
    ``weight`` (1 where an edge has none), in the sorted order of the ends if they go both
    ways; its type is theirs if there is one, else says how many there are.
    """
    weight = F.coalesce(V.number_of(F.col("props")["weight"]), F.lit(1.0))
    e = g.relationships.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    first = F.min_by(F.struct(*EDGE_COLUMNS), "ord")
    pairs = e.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("type")).alias("types"), (F.min(F.col("src") == F.col("a")) != F.max(F.col("src") == F.col("a"))).alias("both"),
        F.sum(weight).alias("w"), first.alias("e"),
    )
    several = F.col("n") > 1
    number = F.when(F.col("w") == F.floor("w"), F.col("w").cast("bigint").cast("variant")).otherwise(F.col("w").cast("variant"))
    made = F.create_map(
        F.lit("collapsed"), F.lit(True).cast("variant"), F.lit("count"), F.col("n").cast("variant"), F.lit("types"), F.col("types").cast("variant"),
        F.lit("bidirectional"), F.col("both").cast("variant"), F.lit("weight"), number,
    )
    named = F.when(F.size("types") == 1, F.get("types", F.lit(0))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" relationships")))
    edges = pairs.select(
        F.col("e.ord").alias("ord"), F.when(several & F.col("both"), F.col("a")).otherwise(F.col("e.src")).alias("src"), F.when(several & F.col("both"), F.col("b")).otherwise(F.col("e.dst")).alias("dst"),
        F.when(several, named).otherwise(F.col("e.type")).alias("type"), F.when(several, made).otherwise(F.col("e.props")).alias("props"), F.when(~several, F.col("e.rel_id")).alias("rel_id"),
    )
    return _fresh(g, g.entities, edges, derived_fields=dict(g.derived_fields))


def peel(g: PropertyGraph, k: int) -> tuple[DataFrame, DataFrame]:
    """``(id)`` of the k-core and the distinct neighbour pairs ``(id, nbr)`` that peeling began with.

    Each round removes all entities with fewer than ``k`` remaining neighbours; pairs are
    written between rounds, so that a round reads only what the one before left.
    """
    work = Workspace(g.entities.sparkSession, "kcore")
    ids = g.entities.select("id")
    pairs = work.save(among(among(g.neighbours(), ids, "id"), ids, "nbr"), "pairs")
    left, n = pairs, None
    while True:
        strong = left.groupBy("id").agg(F.count("*").alias("degree")).where(F.col("degree") >= k).select("id")
        strong = work.save(strong, "strong")
        m = strong.count()
        if m == n or m == 0:
            return strong, pairs
        left = work.save(among(among(left, strong, "id"), strong, "nbr"), "left")
        n = m


def simplify(g: PropertyGraph, min_connections: int | None = None) -> PropertyGraph:
    """The k-core; survivors say in ``simplified`` how many neighbours of each type they lost.

    Without ``min_connections`` k is 2, then one more at each call.  The same graph comes
    back, with a warning, where nothing or everything would go.
    """
    k = min_connections if min_connections is not None else (g.simplification_k + 1 if g.simplification_k is not None else 2)
    core, pairs = peel(g, k)
    n = core.count()
    if k <= 0 or n in (0, g.entities.count()):
        note(f"with {k} connections simplify would change nothing or leave nothing; the graph stays as it is")
        return g
    kinds = g.entities.select(F.col("id").alias("nbr"), primary_type(F.col("types")).alias("t"))
    lost = without(among(pairs, core, "id"), core, "nbr").join(kinds, "nbr").groupBy("id", "t").agg(F.count("*").alias("n"))
    lost = lost.groupBy("id").agg(F.to_variant_object(F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", "n"))))).alias("lost"))
    marked = F.when(F.col("lost").isNull(), F.col("props")).otherwise(F.map_concat(F.map_filter("props", lambda key, _: key != "simplified"), F.create_map(F.lit("simplified"), F.col("lost"))))
    entities = among(g.entities, core, "id").join(lost, "id", "left").select("id", "ord", "types", marked.alias("props"), "source")
    return g.derive(entities, edges_between(g.relationships, core), simplification_k=k)
