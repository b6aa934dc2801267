"""Community detection by modularity (V. Blondel et al., 2008), on an undirected simple graph.

Rounds of local moves run as joins and aggregates: for each entity the gain of each
neighbouring community is summed from the edges, and the best one is taken.  Half of the
entities, by a seeded hash, may move in a round, so neighbours don't swap for ever.  Then
communities become the nodes of a weighted graph and rounds begin again.  Results depend
on the seed only; they are not those of another implementation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.model import PropertyGraph, among
from strandweave.plans.numbering import numbered
from strandweave.plans.workspace import Workspace

ROUNDS, LEVELS = 8, 4


def _one_level(edges: DataFrame, m2: float, resolution: float, seed: int, work: Workspace) -> DataFrame:
    """``(id, c)`` after local moves; edges ``(a, b, w)`` in both directions, loops once with twice their weight."""
    strength = work.save(edges.groupBy("a").agg(F.sum("w").alias("k")).withColumnRenamed("a", "id"), "strength")
    member = work.save(strength.select("id", "k", F.col("id").alias("c")), "member")
    links = edges.where("a != b")
    for turn in range(ROUNDS):
        totals = member.groupBy("c").agg(F.sum("k").alias("tot"))
        to = links.join(member.select(F.col("id").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w")).withColumnRenamed("a", "id")
        options = to.unionByName(member.select("id", "c", F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"))
        own = member.select("id", "k", F.col("c").alias("own"))
        scored = options.join(own, "id").join(totals, "c")
        gain = F.col("w") - F.lit(resolution) * F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / m2
        best = scored.withColumn("gain", F.round(gain, 9)).groupBy("id").agg(F.max_by(F.struct("c", "gain"), F.struct("gain", F.xxhash64("c", F.lit(seed)))).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
        free = F.pmod(F.xxhash64("id", F.lit(seed + turn)), F.lit(2)) == 0
        moved = free & (F.col("best.gain") > F.col("stay") + 1e-9)
        nxt = work.save(member.join(best, "id").select("id", "k", F.when(moved, F.col("best.c")).otherwise(F.col("c")).alias("c"), moved.alias("moved")), "member")
        done = nxt.where("moved").isEmpty() and turn > 0
        member = nxt.select("id", "k", "c")
        if done:
            break
    return member.select("id", "c")


def communities(g: PropertyGraph, resolution: float = 1.0, seed: int | None = None) -> DataFrame:
    """``(id, community)`` for each entity, numbered from 0 by size; isolated ones alone."""
    work = Workspace(g.entities.sparkSession, "communities")
    seed = 0 if seed is None else seed
    known = g.entities.select("id")
    simple = among(among(g.neighbours(), known, "id"), known, "nbr")
    edges = work.save(simple.select(F.col("id").alias("a"), F.col("nbr").alias("b"), F.when(F.col("id") == F.col("nbr"), 2.0).otherwise(1.0).alias("w")), "edges")
    label = work.save(known.select("id", F.col("id").alias("c")), "label")
    m2 = edges.agg(F.sum("w")).first()[0]
    for _ in range(LEVELS if m2 else 0):
        moved = _one_level(edges, m2, resolution, seed, work)
        before = edges.select("a").distinct().count()
        after = moved.select("c").distinct().count()
        label = work.save(label.join(moved.select(F.col("id").alias("c"), F.col("c").alias("n")), "c", "left").select("id", F.coalesce("n", "c").alias("c")), "label")
        if after == before:
            break
        lift = lambda end: moved.select(F.col("id").alias(end), F.col("c").alias(f"{end}c"))
        edges = work.save(edges.join(lift("a"), "a").join(lift("b"), "b").groupBy(F.col("ac").alias("a"), F.col("bc").alias("b")).agg(F.sum("w").alias("w")), "edges")
    sizes = label.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    ranked = numbered(sizes, F.desc("n"), "first", name="community", work=work).select("c", "community")
    return label.join(ranked, "c").select("id", "community")


def detect_communities(g: PropertyGraph, resolution: float = 1.0, seed: int | None = None) -> PropertyGraph:
    """The graph with each entity's community as a property."""
    from strandweave.operators.annotate import with_fields

    found = communities(g, resolution, seed)
    rows = g.entities.join(found, "id", "left")
    entities = rows.select("id", "ord", "types", with_fields(F.col("props"), {"community": F.col("community").cast("variant")}).alias("props"), "source")
    return g.derive(entities, g.relationships, derived_fields=g.derived_fields | {"community": "detect_communities"})


def modularity(edges: DataFrame, label: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of ``label (id, community)`` on ``edges (id, nbr)`` in both directions."""
    m2 = edges.count()
    if not m2:
        return 0.0
    inside = edges.join(label, "id").join(label.toDF("nbr", "other"), "nbr").where("community = other").count()
    square = edges.groupBy("id").count().join(label, "id").groupBy("community").agg(F.sum("count").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / m2 - resolution * square / (m2 * m2)
