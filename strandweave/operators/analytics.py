"""Summaries, degree ranking, coverage and structural profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.model import PropertyGraph, primary_type, shown_type
from strandweave.operators.components import connected_components
from strandweave.operators.records import label


def most_connected(g: PropertyGraph, n: int = 10, entity_types=None) -> DataFrame:
    """The ``n`` entities with the most distinct neighbours; ties in the order of the input."""
    entities = g.entities
    if entity_types is not None:
        names = [entity_types] if isinstance(entity_types, str) else list(entity_types)
        for t in names:
            g.types.validate(t)
        entities = entities.where(F.arrays_overlap("types", F.array(*[F.lit(t) for t in names])))
    counted = g.neighbours().groupBy("id").agg(F.count("*").alias("degree"))
    ranked = entities.join(counted, "id", "left").select("id", label(F.col("id"), F.col("props")).alias("label"), shown_type(F.col("types")).alias("type"), F.coalesce("degree", F.lit(0)).alias("degree"), "ord")
    return ranked.orderBy(F.desc("degree"), "ord", "id").limit(n).drop("ord")


def summary(g: PropertyGraph, top: int = 5) -> dict[str, object]:
    """Counts of entities and relationships, by type, the best connected and the sources."""
    by_type = g.entities.groupBy(shown_type(F.col("types")).alias("type")).agg(F.count("*").alias("n"), F.min("ord").alias("o")).orderBy(F.desc("n"), "o").collect()
    by_rel = g.relationships.groupBy("type").agg(F.count("*").alias("n"), F.min("ord").alias("o")).orderBy(F.desc("n"), "o").collect()
    return {
        "entities": sum(r["n"] for r in by_type), "relationships": sum(r["n"] for r in by_rel), "entity_types": {r["type"]: r["n"] for r in by_type},
        "relationship_types": {r["type"]: r["n"] for r in by_rel}, "most_connected": most_connected(g, top).collect(), "sources": g.sources,
    }


def type_counts(g: PropertyGraph) -> DataFrame:
    """``(kind, type, n)``: entities by shown type and relationships by type."""
    e = g.entities.groupBy(shown_type(F.col("types")).alias("type")).agg(F.count("*").alias("n")).select(F.lit("entity").alias("kind"), "type", "n")
    return e.unionAll(g.relationships.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("relationship"), "type", "n"))


def coverage(g: PropertyGraph, inline_relations=False, min_occurrences: int = 5) -> DataFrame:
    """What share of each type takes part in each relationship pattern, the worst first.

    A pattern is (relationship type, source and target primary type, reified); by default
    reified ones only, with ``inline_relations`` all or the listed inline types too.
    """
    kinds = g.entities.select("id", primary_type(F.col("types")).alias("t"))
    edges = g.relationships.select("src", "dst", "type", F.col("rel_id").isNotNull().alias("reified"))
    if inline_relations is False:
        edges = edges.where("reified")
    elif inline_relations is not True:
        edges = edges.where(F.col("reified") | F.col("type").isin(list(inline_relations)))
    typed = edges.join(kinds.toDF("src", "source_type"), "src").join(kinds.toDF("dst", "target_type"), "dst")
    keys = ["type", "source_type", "target_type", "reified"]
    # one pass per side over (pattern, end) counts: no expansion for several distinct counts
    def side(end: str, name: str, own: str) -> DataFrame:
        ends = typed.groupBy(*keys, end).agg(F.count("*").alias("n"))
        return ends.groupBy(*keys).agg(F.sum("n").alias("occurrences"), F.count("*").alias("reached")).where(F.col("occurrences") >= min_occurrences).withColumn("side", F.lit(name)).withColumn("entity_type", F.col(own))

    totals = kinds.groupBy(F.col("t").alias("entity_type")).agg(F.count("*").alias("total"))
    both = side("src", "source", "source_type").unionByName(side("dst", "target", "target_type"))
    out = both.join(totals, "entity_type").withColumn("fraction", F.col("reached") / F.col("total"))
    return out.select(F.col("type").alias("relationship_type"), "source_type", "target_type", "reified", "occurrences", "side", "entity_type", "reached", "total", "fraction").orderBy("fraction", "relationship_type", "source_type", "target_type", "side")


def components(g: PropertyGraph) -> DataFrame:
    """``(id, component)`` for each entity: the smallest id it is connected with, its own if isolated."""
    known = g.entities.select("id")
    found = connected_components(g.relationships.select("src", "dst"))
    return known.join(found.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def degree_statistics(degrees: DataFrame) -> DataFrame:
    """Largest, mean, median and skewness (population form, 0 for fewer than 3 or equal degrees), and isolates."""
    d = F.col("degree")
    return degrees.agg(
        F.coalesce(F.max(d), F.lit(0)).alias("degree_max"), F.coalesce(F.avg(d), F.lit(0.0)).alias("degree_mean"), F.coalesce(F.median(d), F.lit(0.0)).alias("degree_median"),
        F.when(F.count(d) >= 3, F.coalesce(F.skewness(d), F.lit(0.0))).otherwise(0.0).alias("degree_skewness"), F.count_if(d == 0).alias("isolates"),
    )


def multiplicity(g: PropertyGraph) -> DataFrame:
    """Edges by unordered pair of distinct entities: the most, the mean; and self-loops."""
    pairs = g.relationships.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))
    apart = F.col("a") != F.col("b")
    return pairs.agg(
        F.coalesce(F.max(F.when(apart, F.col("n"))), F.lit(0)).alias("multiplicity_max"), F.coalesce(F.avg(F.when(apart, F.col("n"))), F.lit(0.0)).alias("multiplicity_mean"),
        F.coalesce(F.sum(F.when(~apart, F.col("n"))), F.lit(0)).alias("self_loops"),
    )


def profile(g: PropertyGraph) -> DataFrame:
    """One row of structural measures of the graph."""
    from strandweave.model import has_data

    primary = primary_type(F.col("types"))
    kinds = g.entities.groupBy(primary.alias("t")).agg(F.count("*").alias("n"))
    top = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entities"), F.count("*").alias("entity_types"), F.coalesce(F.max("n"), F.lit(0)).alias("top_n"), F.max_by("t", F.struct(F.col("n"), F.col("t"))).alias("top_type"))
    secondary = g.entities.select(F.explode(F.slice("types", 2, 1 << 20)).alias("s")).agg(F.count_distinct("s").alias("secondary_types"))
    data = g.entities.agg(F.count_if(F.coalesce(has_data(), F.lit(False))).alias("data_entities"))
    edges = g.relationships.groupBy("type").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("relationships"), F.count("*").alias("relationship_types"))
    parts = components(g).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_component"))
    # each side is one row
    row = top.crossJoin(secondary).crossJoin(data).crossJoin(edges).crossJoin(parts).crossJoin(degree_statistics(g.degrees())).crossJoin(multiplicity(g))
    n = F.col("entities")
    share = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0.0)
    return row.select(
        "entities", "relationships", F.when(n > 1, F.col("relationships") / (n * (n - 1))).otherwise(0.0).alias("density"), "entity_types", "secondary_types", "relationship_types", "top_type", share("top_n").alias("top_type_fraction"),
        "data_entities", share("data_entities").alias("data_fraction"), "components", share("largest_component").alias("largest_component_fraction"), "degree_max", "degree_mean", "degree_median", "degree_skewness",
        "multiplicity_max", "multiplicity_mean", "self_loops", "isolates",
    )


def type_adjacency(g: PropertyGraph) -> DataFrame:
    """``(a, b, n)``: relationships by unordered pair of primary types."""
    kinds = g.entities.select("id", primary_type(F.col("types")).alias("t"))
    typed = g.relationships.select("src", "dst").join(kinds.toDF("src", "s"), "src").join(kinds.toDF("dst", "d"), "dst")
    return typed.groupBy(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).agg(F.count("*").alias("n"))


def cap_most_connected(g: PropertyGraph, n: int = 10_000) -> PropertyGraph:
    """The graph among its ``n`` most connected entities."""
    return g.induce(most_connected(g, n).select("id"))


class Corpus:
    """Many graphs, profiled one by one."""

    def __init__(self, *paths: str, readers=None):
        self.paths, self.readers = paths, readers

    def profile(self, spark) -> tuple[DataFrame | None, list[tuple[str, str]]]:
        """A row of measures for each readable path, and ``(path, message)`` for the others.

        Globs are expanded and equal paths taken once; a glob without a match is skipped.
        """
        import glob
        import os

        from strandweave import sources

        found, seen, rows, failures = [], set(), None, []
        for p in self.paths:
            found += sorted(glob.glob(p)) if glob.has_magic(p) else [p]
        for p in found:
            if (key := os.path.realpath(p)) in seen:
                continue
            seen.add(key)
            try:
                one = profile(sources.read(spark, p, readers=self.readers)).select(F.lit(p).alias("path"), "*")
                rows = one if rows is None else rows.unionByName(one)
            except Exception as e:  # noqa: BLE001  one bad path must not end the others
                failures.append((p, str(e)))
        return rows, failures


def corpus_statistics(profiles: DataFrame) -> DataFrame:
    """``(measure, min, max, median)`` over the graphs' profiles."""
    numbers = [c for c, t in profiles.dtypes if t in ("bigint", "double", "int")]
    stacked = profiles.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in numbers])).alias("m")).select("m.*")
    return stacked.groupBy("measure").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.median("v").alias("median"))
