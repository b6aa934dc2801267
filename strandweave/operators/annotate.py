"""Derived properties from expressions over an entity and what it is related to.

A function is called once with a symbolic entity.  What it builds is a column, or a
request for related entities that one aggregation answers for all entities together; a
function that needs real values runs row by row on the entity's own properties instead.
Fields of one call don't see each other, and the result is a root of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions import temporal
from strandweave.functions import variants as V
from strandweave.model import EDGE_COLUMNS, ENTITY_COLUMNS, PropertyGraph, note, primary_type
from strandweave.operators.records import label

Key = str | Callable | None


class CardinalityError(ValueError):
    """More related entities than a field allows; the name stands in the query's error."""


@dataclass(frozen=True)
class Related:
    """Entities one step away, each once, in the order of the edges (outgoing ones first).

    A ``key`` is the name of a property, a function of the related entity, or None for its
    label; missing and null values are skipped.
    """

    relation: str
    direction: str = "out"

    def first(self, key: Key = None, *, default=None, strict: bool = False) -> Request:
        """The first value, else ``default``; with ``strict`` an error where there are several entities."""
        return Request(self, "first", key, default=default, strict=strict)

    def only(self, key: Key = None) -> Request:
        """The value of the only one; an error where there are several."""
        return self.first(key, strict=True)

    def join(self, key: Key = None, separator: str = ", ", *, unique: bool = True, sort: bool = True, default=None) -> Request:
        """Values as text, joined; ``default`` where there is none."""
        return Request(self, "join", key, separator, default, unique=unique, sort=sort)

    def list(self, key: Key = None, *, unique: bool = False, sort: bool = False) -> Request:
        """Values in the order of the entities; sorted, as text if they aren't all numbers."""
        return Request(self, "list", key, unique=unique, sort=sort)

    def count(self) -> Request:
        return Request(self, "count")

    def exists(self) -> Request:
        return Request(self, "exists")


@dataclass(frozen=True)
class Request:
    """One aggregate over related entities."""

    related: Related
    how: str
    key: Key = None
    separator: str = ", "
    default: object = None
    strict: bool = False
    unique: bool = False
    sort: bool = False


class EntityExpr:
    """A symbolic entity: attributes and properties are columns."""

    def __init__(self, prefix: str = ""):
        self._c = lambda name: F.col(f"{prefix}{name}")

    @property
    def id(self) -> Column:
        return self._c("id")

    @property
    def type(self) -> Column:
        return primary_type(self._c("types"))

    @property
    def types(self) -> Column:
        return self._c("types")

    @property
    def label(self) -> Column:
        return label(self._c("id"), self._c("props"))

    def get(self, key: str) -> Column:
        """A property as a variant."""
        return self._c("props")[key]

    def text(self, key: str) -> Column:
        return V.text_of(self.get(key))

    def number(self, key: str) -> Column:
        return V.number_of(self.get(key))

    def __getitem__(self, key: str) -> Column:
        return self.get(key)

    def _when(self, name: str) -> Column:
        return temporal.entity_temporal(self._c("props"))[name]

    year = property(lambda self: self._when("year"))
    start_date = property(lambda self: self._when("start_date"))
    end_date = property(lambda self: self._when("end_date"))
    date_precision = property(lambda self: self._when("precision"))
    date_circa = property(lambda self: self._when("circa"))
    date_uncertain = property(lambda self: self._when("uncertain"))

    def parse_date(self, *keys: str) -> Column:
        return temporal.first_parsed(self._c("props"), list(keys))["start"]

    def parse_year(self, *keys: str) -> Column:
        return temporal.first_parsed(self._c("props"), list(keys))["year"]

    def related(self, relation: str, direction: str = "out") -> Related:
        return Related(relation, direction)

    def has(self, relation: str, direction: str = "out") -> Request:
        return Related(relation, direction).exists()


class RelationshipExpr:
    """A symbolic relationship with its two ends."""

    def __init__(self):
        self.source, self.target = EntityExpr("_s_"), EntityExpr("_t_")

    type = property(lambda self: F.col("type"))
    id = property(lambda self: F.col("rel_id"))

    def get(self, key: str) -> Column:
        return F.col("props")[key]

    __getitem__ = get


def related_ids(g: PropertyGraph, relation: str, direction: str = "out") -> DataFrame:
    """``(id, nbr, side, ord)``: related entities, each once, where their first edge stands."""
    if direction not in ("out", "in", "any"):
        raise ValueError("direction is 'out', 'in' or 'any'")
    g.relationship_types.validate(relation)
    e = g.relationships.where(F.col("type") == relation)
    out = e.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), F.lit(0).alias("side"), "ord")
    back = e.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), F.lit(1).alias("side"), "ord")
    both = out if direction == "out" else back if direction == "in" else out.unionAll(back)
    return both.groupBy("id", "nbr").agg(F.min(F.struct("side", "ord")).alias("at")).select("id", "nbr", "at.side", "at.ord")


def _value(key: Key) -> Column:
    """What a key gives for an entity, as a variant."""
    if key is None:
        return EntityExpr().label.cast("variant")
    if callable(key):
        made = key(EntityExpr())
        if not isinstance(made, Column):
            raise TypeError("the key of related entities is a function that gives a column")
        return made.cast("variant")
    return F.col("props")[key]


def _answered(g: PropertyGraph, requests: list[tuple[str, Request]]) -> DataFrame:
    """``g.entities`` with a column for each request."""
    rows = g.entities
    groups: dict[Related, list[tuple[str, Request]]] = {}
    for name, r in requests:
        groups.setdefault(r.related, []).append((name, r))
    for related, asked in groups.items():
        links = related_ids(g, related.relation, related.direction)
        keys = list(dict.fromkeys(r.key for _, r in asked if r.how not in ("count", "exists")))
        if keys:
            made = g.entities.select(F.col("id").alias("nbr"), *[F.struct(_value(k).alias("v")).alias(f"_k_{i}") for i, k in enumerate(keys)])
            # JSON keeps the kind of a value, and can be compared
            read = lambda v: F.when(V.present(v), F.struct(F.to_json(v).alias("json"), V.shown(v).alias("text"), F.when(V.is_number(v), V.number_of(v)).alias("number")))
            values = made.select("nbr", *[read(F.col(f"_k_{i}")["v"]).alias(f"_v_{i}") for i in range(len(keys))])
            links = links.join(values, "nbr")
        place = F.struct("side", "ord", "nbr")
        single, listed = [], []
        for name, r in asked:
            v = F.col(f"_v_{keys.index(r.key)}") if r.how not in ("count", "exists") else None
            if r.how in ("join", "list"):
                listed.append((name, r, v))
            elif r.how == "first":
                found = F.min_by(v["json"], F.when(v.isNotNull(), place))
                message = F.concat(F.lit(f"{CardinalityError.__name__}: more than one {related.relation} of "), F.min("id"))
                single.append((F.when(F.count("*") > 1, F.raise_error(message).cast("string")).otherwise(found) if r.strict else found).alias(name))
            else:
                single.append((F.count("*") if r.how == "count" else F.count("*") > 0).alias(name))
        if single:
            rows = rows.join(links.groupBy("id").agg(*single), "id", "left")
        for name, r, v in listed:
            own = links.where(v.isNotNull()).select("id", v.alias("v"), place.alias("at"))
            if r.unique:
                # equal values meet before they are listed, so a list is as long as its distinct values
                same = F.col("v.text") if r.how == "join" else F.col("v.json")
                own = own.groupBy("id", same.alias("same")).agg(F.min(F.struct("at", "v")).alias("m")).select("id", "m.at", "m.v")
            values = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("found"))
            values = values.select("id", _let(F.transform("found", lambda x: x["v"]), _listed(r)).alias(name))
            rows = rows.join(values, "id", "left")
        for name, r in asked:
            if r.how in ("count", "exists"):
                rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(0 if r.how == "count" else False)).cast("variant"))
            elif r.how == "join":
                rows = rows.withColumn(name, F.coalesce(F.col(name).cast("variant"), F.lit(r.default).cast("variant")))
            elif r.how == "list":
                rows = rows.withColumn(name, F.parse_json(F.coalesce(F.col(name), F.lit("[]"))))
            else:
                rows = rows.withColumn(name, F.coalesce(F.parse_json(F.col(name)), F.lit(r.default).cast("variant")))
    return rows


def _let(value: Column, function) -> Column:
    """``function`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _listed(r: Request):
    """A function from values to the text of their list, joined or as JSON."""

    def joined(found: Column) -> Column:
        texts = F.transform(found, lambda x: x["text"])
        return F.array_join(F.array_sort(texts) if r.sort else texts, r.separator)

    def as_json(found: Column) -> Column:
        ordered = lambda by: F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x[by].alias("by"), x["json"].alias("json")))), lambda x: x["json"])
        jsons = F.transform(found, lambda x: x["json"])
        if r.sort:
            jsons = F.when(F.forall(found, lambda x: x["number"].isNotNull()), ordered("number")).otherwise(ordered("text"))
        return F.concat(F.lit("["), F.array_join(jsons, ","), F.lit("]"))

    return joined if r.how == "join" else as_json


def with_fields(props: Column, fields: dict[str, Column]) -> Column:
    """Properties with new values; a NULL value leaves no key."""
    pairs = [x for k, c in fields.items() for x in (F.lit(k), c)]
    made = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(props, lambda k, _: ~k.isin(list(fields))), made)


def _variant(c: Column) -> Column:
    return c.cast("variant")


def _traced(function: Callable, symbol):
    try:
        made = function(symbol)
    except Exception:  # noqa: BLE001  arbitrary Python meets a column: run it on rows
        return None
    return made if isinstance(made, (Column, Request)) else F.lit(made) if isinstance(made, (str, int, float, bool)) else None


def _row_udf(function: Callable, name: str):
    """A function of real values, run in batches on ``(id, properties as JSON)``."""
    import json

    import pandas as pd

    class View(dict):
        def __init__(self, id_, properties):
            super().__init__(properties)
            self.id = id_

    def run(ids: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for i, t in zip(ids, texts, strict=True):
            try:
                out.append(json.dumps(function(View(i, json.loads(t)))))
            except Exception as e:
                raise RuntimeError(f"field {name!r} failed on {i!r}: {e}") from e
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"ids": pd.Series, "texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def _all_json(props: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(props), lambda e: F.concat(F.to_json(e["key"].cast("variant")), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null")))), ","), F.lit("}"))


def annotate_entities(g: PropertyGraph, fields: dict[str, Callable | Column]) -> PropertyGraph:
    """Entities with new properties, each a column or a function of the entity."""
    requests, columns = [], {}
    for name, f in fields.items():
        made = f if isinstance(f, Column) else _traced(f, EntityExpr())
        if isinstance(made, Request):
            requests.append((f"_r_{name}", made))
            columns[name] = F.col(f"_r_{name}")
        elif made is not None:
            columns[name] = _variant(made)
        else:
            columns[name] = F.try_parse_json(_row_udf(f, name)(F.col("id"), _all_json(F.col("props"))))
    rows = _answered(g, requests)
    entities = rows.select("id", "ord", "types", with_fields(F.col("props"), columns).alias("props"), "source")
    return replace(g, entities=entities, origin=None, simplification_k=None, derived_fields=g.derived_fields | dict.fromkeys(fields, "annotate_entities"))


def annotate_relationships(g: PropertyGraph, fields: dict[str, Callable | Column]) -> PropertyGraph:
    """Relationships with new properties, each a column or a function of the relationship."""
    ends = lambda p, end: g.entities.select(*[F.col(c).alias(f"{p}{c}") for c in ("id", "types", "props")]).withColumn(end, F.col(f"{p}id"))
    rows = g.relationships.join(ends("_s_", "src"), "src", "left").join(ends("_t_", "dst"), "dst", "left")
    columns = {}
    for name, f in fields.items():
        made = f if isinstance(f, Column) else _traced(f, RelationshipExpr())
        columns[name] = _variant(made) if isinstance(made, Column) else F.try_parse_json(_row_udf(f, name)(F.coalesce("rel_id", "type"), _all_json(F.col("props"))))
    edges = rows.withColumn("props", with_fields(F.col("props"), columns)).select(*EDGE_COLUMNS)
    return replace(g, relationships=edges, origin=None, simplification_k=None, relationship_derived_fields=g.relationship_derived_fields | dict.fromkeys(fields, "annotate_relationships"))


DATE_FIELDS = ("start_date", "end_date", "year", "date_precision", "date_circa", "date_uncertain")


def convert_dates(g: PropertyGraph, start=None, end=None, parser: Callable | None = None, report: bool = False) -> PropertyGraph:
    """Entities with their dates as properties: ISO text, year, precision and flags.

    Entities without a date that parses stay as they are.  ``parser`` makes a value of
    ``temporal.Temporal`` from a string, or None.
    """
    when = temporal.entity_temporal(F.col("props"), start, end, parser)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    d = F.col("_d")
    columns = dict(zip(DATE_FIELDS, map(_variant, (iso(d["start_date"]), iso(d["end_date"]), d["year"], d["precision"], d["circa"], d["uncertain"])), strict=True))
    rows = g.entities.withColumn("_d", when)
    entities = rows.withColumn("props", F.when(F.col("_d").isNull(), F.col("props")).otherwise(with_fields(F.col("props"), columns))).select(*ENTITY_COLUMNS)
    if report:
        found = rows.agg(F.count_if(F.col("_d").isNotNull()), F.count("*")).first()
        note(f"{found[0]} of {found[1]} entities have a date that parses")
    return replace(g, entities=entities, origin=None, simplification_k=None, derived_fields=g.derived_fields | dict.fromkeys(DATE_FIELDS, "convert_dates"))
