"""Fuzzy text search over properties, and the way into semantic search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import variants as V
from strandweave.functions.similarity import fuzzy_score
from strandweave.model import PropertyGraph


def fuzzy_hits(g: PropertyGraph, query: str, properties=None, threshold: float = 80) -> DataFrame:
    """``(id, score, property, value)``: the best property of each entity at or over the threshold.

    Of equal scores the first property in the map's order wins; values are shown as text.
    """
    pairs = g.entities.select("id", F.posexplode("props").alias("pos", "property", "value"))
    if properties is not None:
        pairs = pairs.where(F.col("property").isin([properties] if isinstance(properties, str) else list(properties)))
    shown = pairs.where(V.present(F.col("value"))).select("id", "pos", "property", V.shown(F.col("value")).alias("value"))
    scored = shown.withColumn("score", fuzzy_score(query)(F.col("value"))).where(F.col("score") >= threshold)
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", "property", "value")).alias("b"))
    return best.select("id", (-F.col("b.s")).alias("score"), "b.property", F.when(F.length("b.value") > 80, F.concat(F.substring("b.value", 1, 77), F.lit("..."))).otherwise(F.col("b.value")).alias("value"))


def search(g: PropertyGraph, query: str, mode: str = "fuzzy", *, properties=None, threshold: float = 80, top_n: int = 10, k: int = 10, store_path=None, filters=None, restrict_to_view: bool = True, show: bool = False, embed=None) -> PropertyGraph:
    """The graph of the entities that match; ``mode`` is ``fuzzy`` or ``semantic``."""
    if mode == "semantic":
        from strandweave.operators import semantic

        return semantic.search_entities(g, query, k=k, store_path=store_path, filters=filters, restrict_to_view=restrict_to_view, embed=embed)
    if mode != "fuzzy":
        raise ValueError(f"unknown search mode {mode!r}; use 'fuzzy' or 'semantic'")
    hits = fuzzy_hits(g, query, properties, threshold)
    if show:
        hits.orderBy(F.desc("score"), "id").limit(top_n).show(truncate=False)
    return g.induce(hits)
