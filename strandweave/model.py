"""The property graph: two DataFrames and what is known of them.

``entities``: ``(id string, ord long, types array<string>, props map<string,variant>,
source string)``, one row for each id.  ``relationships``: ``(ord long, src string, dst
string, type string, props map<string,variant>, rel_id string)``, a multigraph; ``rel_id``
is null for inline edges.  ``ord`` is the order of the input.  Graphs don't change: each
operator gives a new one with a longer lazy plan.
"""

from __future__ import annotations

import difflib
import hashlib
import warnings
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROPS = "map<string,variant>"
ENTITY_COLUMNS = ["id", "ord", "types", "props", "source"]
EDGE_COLUMNS = ["ord", "src", "dst", "type", "props", "rel_id"]


def no_props() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))


def props(**columns: Column) -> Column:
    """A property map of columns; what is NULL is left out."""
    pairs = [x for name, c in columns.items() for x in (F.lit(name), c.cast("variant"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else no_props()


def primary_type(types: Column, empty: str = "Unknown") -> Column:
    return F.coalesce(F.get(types, F.lit(0)), F.lit(empty))


def shown_type(types: Column) -> Column:
    return F.when(F.size(types) > 0, F.array_join(types, ", ")).otherwise(F.lit("Unknown"))


class TypeRegistry:
    """Known type names, with suggestions for a wrong one."""

    def __init__(self, names, what: str = "type"):
        self.names, self.what = sorted(names), what

    def __iter__(self):
        return iter(self.names)

    def __len__(self):
        return len(self.names)

    def __contains__(self, name) -> bool:
        return name in self.names

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self.validate(name)
        except ValueError as e:
            raise AttributeError(str(e)) from None

    def __dir__(self):
        return [*super().__dir__(), *self.names]

    def suggest(self, name: str) -> list[str]:
        ranked = sorted(((difflib.SequenceMatcher(None, name.lower(), n.lower()).ratio(), n) for n in self.names), key=lambda x: (-x[0], x[1]))
        return [n for score, n in ranked[:3] if score >= 0.5]

    def validate(self, name: str) -> str:
        if name in self.names:
            return name
        hint = f" Did you mean {', '.join(map(repr, near))}?" if (near := self.suggest(name)) else ""
        raise ValueError(f"Unknown {self.what} {name!r}.{hint}")

    def __repr__(self) -> str:
        return f"TypeRegistry({self.names})"


@dataclass(frozen=True)
class PropertyGraph:
    entities: DataFrame
    relationships: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)
    source: str | None = None
    origin: PropertyGraph | None = None
    simplification_k: int | None = None
    derived_fields: dict[str, str] = field(default_factory=dict)
    relationship_derived_fields: dict[str, str] = field(default_factory=dict)

    # -- structure ---------------------------------------------------------------

    @property
    def root(self) -> PropertyGraph:
        """The graph that ``expand`` walks over."""
        return self.origin or self

    def derive(self, entities: DataFrame, relationships: DataFrame, **changes) -> PropertyGraph:
        """A graph cut from this one: same root and derived fields, a fresh simplification count."""
        return replace(self, entities=entities, relationships=relationships, origin=self.root, **({"simplification_k": None} | changes))

    def induce(self, ids: DataFrame) -> PropertyGraph:
        """The entities in ``ids (id)`` and the relationships between them."""
        kept = among(self.entities, ids.select("id").distinct(), "id")
        return self.derive(kept, edges_between(self.relationships, kept))

    def filter_entities(self, condition: Column) -> PropertyGraph:
        """The entities that meet a condition on their own columns, and the relationships between them."""
        kept = self.entities.where(F.coalesce(condition, F.lit(False)))
        return self.derive(kept, edges_between(self.relationships, kept))

    def neighbours(self) -> DataFrame:
        """``(id, nbr)``: each entity's distinct neighbours in both directions, itself for a self-loop."""
        ends = self.relationships.select("src", "dst")
        pairs = ends.toDF("id", "nbr").unionAll(ends.select(F.col("dst"), F.col("src")).toDF("id", "nbr")).distinct()
        return pairs

    def degrees(self) -> DataFrame:
        """``(id, degree)`` for each entity; 0 without neighbours."""
        counted = self.neighbours().groupBy("id").agg(F.count("*").alias("degree"))
        return self.entities.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    # -- access ------------------------------------------------------------------

    @cached_property
    def types(self) -> TypeRegistry:
        rows = self.entities.select(F.explode("types").alias("t")).distinct().collect()
        return TypeRegistry([r["t"] for r in rows], "entity type")

    @cached_property
    def relationship_types(self) -> TypeRegistry:
        rows = self.relationships.select("type").distinct().collect()
        return TypeRegistry([r["type"] for r in rows if r["type"] is not None], "relationship type")

    @property
    def sources(self) -> list[str]:
        rows = self.entities.where("source IS NOT NULL").select("source").distinct().collect()
        return sorted(r["source"] for r in rows)

    @property
    def title(self) -> str:
        for key in ("name", "title"):
            if self.metadata.get(key):
                return str(self.metadata[key])
        names = [str(m.get("name") or m.get("title")) for m in self.metadata.values() if isinstance(m, dict) and (m.get("name") or m.get("title"))]
        return ", ".join(names) or "Untitled collection"

    @property
    def files(self) -> DataFrame:
        """Entities with data of their own, in the order of their raw ids."""
        from strandweave.functions import variants as V

        own = self.entities.where(has_data())
        return own.orderBy(F.coalesce(V.text_of(F.col("props")["raw_id"]), F.col("id")))

    def __len__(self) -> int:
        return self.entities.count()

    def get(self, entity_id: str):
        """The entity's row, or None."""
        return self.entities.where(F.col("id") == entity_id).first()

    def entity_view(self, entity_id: str) -> PropertyGraph:
        """The entity with its direct neighbours."""
        return self.select(id=entity_id).expand()

    @property
    def default_index_path(self) -> str:
        sources = self.sources or ([self.source] if self.source else [])
        if len(sources) == 1:
            return f"{sources[0].rstrip('/').rpartition('/')[2]}-index"
        return f"corpus-{hashlib.sha256(chr(10).join(sources).encode()).hexdigest()[:8]}"

    def cache(self) -> PropertyGraph:
        return replace(self, entities=self.entities.cache(), relationships=self.relationships.cache())

    # -- operators ---------------------------------------------------------------

    def select(self, **kw):
        from strandweave.operators import filters

        return filters.select(self, **kw)

    def exclude(self, **kw):
        from strandweave.operators import filters

        return filters.exclude(self, **kw)

    def drop(self, values, property=None):
        from strandweave.operators import filters

        return filters.drop(self, values, property)

    def subtract(self, other):
        from strandweave.operators import filters

        return filters.subtract(self, other)

    def where(self, **kw):
        from strandweave.operators import filters

        return filters.where(self, **kw)

    def expand(self, depth=1, entity_types=None, via=None):
        from strandweave.operators import filters

        return filters.expand(self, depth, entity_types, via)

    def pattern(self, from_type=None, via=None, to_type=None):
        from strandweave.operators import filters

        return filters.pattern(self, from_type, via, to_type)

    def query(self, cypher):
        from strandweave.plans import cypher as front_end

        return front_end.query(self, cypher)

    def search(self, query, mode="fuzzy", **kw):
        from strandweave.operators import search

        return search.search(self, query, mode, **kw)

    def summary(self, top=5):
        from strandweave.operators import analytics

        return analytics.summary(self, top)

    def most_connected(self, n=10, entity_types=None):
        from strandweave.operators import analytics

        return analytics.most_connected(self, n, entity_types)

    def profile(self):
        from strandweave.operators import analytics

        return analytics.profile(self)

    def coverage(self, inline_relations=False, min_occurrences=5):
        from strandweave.operators import analytics

        return analytics.coverage(self, inline_relations, min_occurrences)

    def detect_communities(self, resolution=1.0, seed=None):
        from strandweave.operators import communities

        return communities.detect_communities(self, resolution, seed)

    def merge_nodes(self, by):
        from strandweave.operators import transforms

        return transforms.merge_nodes(self, by)

    def merge_by_primary_type(self):
        from strandweave.operators import transforms

        return transforms.merge_by_primary_type(self)

    def collapse_edges(self):
        from strandweave.operators import transforms

        return transforms.collapse_edges(self)

    def simplify(self, min_connections=None):
        from strandweave.operators import transforms

        return transforms.simplify(self, min_connections)

    def annotate_entities(self, **fields):
        from strandweave.operators import annotate

        return annotate.annotate_entities(self, fields)

    def annotate_relationships(self, **fields):
        from strandweave.operators import annotate

        return annotate.annotate_relationships(self, fields)

    def convert_dates(self, start=None, end=None, parser=None, report=False):
        from strandweave.operators import annotate

        return annotate.convert_dates(self, start, end, parser, report)

    def entity_records(self, columns=None):
        from strandweave.operators import records

        return records.entity_records(self, columns)

    def relationship_records(self, columns=None):
        from strandweave.operators import records

        return records.relationship_records(self, columns)

    def entity_counts(self, name):
        from strandweave.operators import records

        return records.entity_counts(self, name)

    def relationship_counts(self, name):
        from strandweave.operators import records

        return records.relationship_counts(self, name)

    def text_records(self, **kw):
        from strandweave.operators import text

        return text.text_records(self, **kw)

    def chunk_records(self, query=None, **kw):
        from strandweave.operators import semantic

        return semantic.chunk_records(self, query, **kw)

    def build_semantic_index(self, store_path=None, **kw):
        from strandweave.operators import semantic

        return semantic.build_index(self, store_path or self.default_index_path, **kw)

    def write(self, path, format=None, overwrite=False):
        from strandweave import sinks

        return sinks.write(self, path, format, overwrite)

    def to_networkx(self):
        from strandweave.sinks import exports

        return exports.to_networkx(self)

    def layout(self, **kw):
        from strandweave.operators import presentation

        return presentation.layout(self, **kw)

    def visualise(self, renderer="2d", **kw):
        from strandweave.operators import presentation

        return presentation.visualise(self, renderer, **kw)

    def glimpse(self, **kw):
        from strandweave.operators import presentation

        return presentation.glimpse(self, **kw)

    def gallery(self, **kw):
        from strandweave.operators import presentation

        return presentation.gallery(self, **kw)

    def inspect(self, entity_id):
        from strandweave.operators import presentation

        return presentation.inspect(self, entity_id)

    def view(self, entity_id):
        from strandweave.operators import presentation

        return presentation.view(self, entity_id)


def among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in ``ids``, one column of distinct values.

    An inner join: the optimiser would push a semi join into each branch of a union below
    it and copy the plan of the ids there.
    """
    return df.join(ids.toDF(key), key).select(*df.columns)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not in ``ids``, one column of distinct values."""
    marked = ids.toDF(key).withColumn("_hit", F.lit(True))
    return df.join(marked, key, "left").where("_hit IS NULL").select(*df.columns)


def edges_between(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with both ends among the entities."""
    ids = entities.select("id")
    return among(among(relationships, ids, "src"), ids, "dst").select(*EDGE_COLUMNS)


def has_data() -> Column:
    root = F.coalesce(F.try_variant_get(F.col("props")["_is_root"], "$", "boolean"), F.lit(False))
    return F.arrays_overlap("types", F.array(F.lit("File"), F.lit("Dataset"))) & ~root


def checked(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relationships with both ends known, and those that are dropped for a missing end."""
    ids = entities.select("id")
    kept = edges_between(relationships, entities)
    lost = without(relationships, ids, "src").unionByName(without(among(relationships, ids, "src"), ids, "dst"))
    return kept, lost.select(*EDGE_COLUMNS)


def last_wins(entities: DataFrame) -> DataFrame:
    """One row for each id: the values of its last row at the place of its first."""
    latest = F.max_by(F.struct("types", "props", "source"), "ord")
    return entities.groupBy("id").agg(F.min("ord").alias("ord"), latest.alias("v")).select("id", "ord", "v.types", "v.props", "v.source")


def note(message: str) -> None:
    warnings.warn(message, stacklevel=3)
