"""Expressions over property values held as variants.

A property is a scalar, a list or an object.  Filters and counts see a list as its
non-null elements and a scalar as a list of one.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_KINDS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def kind(v: Column) -> Column:
    """The variant's own type as text; NULL for a missing value."""
    return F.schema_of_variant(v)


def is_number(v: Column) -> Column:
    return kind(v).rlike(NUMBER_KINDS)


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def number_of(v: Column) -> Column:
    """A number, or a string or boolean that reads as one; else NULL."""
    return F.try_variant_get(v, "$", "double")


def present(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def elements(v: Column) -> Column:
    """Non-null elements of a list; a scalar is a list of one; nothing for a null."""
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    return F.filter(items, present)


def equals(v: Column, value: Any) -> Column:
    """Whether a variant is the Python value, without conversion between text, numbers and booleans."""
    if isinstance(value, bool):
        return (kind(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    if isinstance(value, (int, float)):
        return is_number(v) & (number_of(v) == F.lit(float(value)))
    if isinstance(value, str):
        return (kind(v) == "STRING") & (text_of(v) == F.lit(value))
    import json

    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def any_equals(v: Column, values: list) -> Column:
    """Whether any element is one of the values; objects never match."""
    def one(x: Column) -> Column:
        out = F.lit(False)
        for value in values:
            out = out | F.coalesce(equals(x, value), F.lit(False))
        return out

    return F.exists(elements(v), one)


def shown(v: Column) -> Column:
    """A value as Python's ``str`` shows it: ``True``, ``None``, ``['a', 'b']``; whole numbers without a point."""

    def scalar(x: Column, quoted: bool) -> Column:
        quote = F.concat(F.lit("'"), text_of(x), F.lit("'")) if quoted else text_of(x)
        return (
            F.when(x.isNull() | F.is_variant_null(x), F.lit("None"))
            .when(kind(x) == "BOOLEAN", F.initcap(text_of(x)))
            .when(kind(x) == "STRING", quote)
            .otherwise(F.to_json(x))
        )

    items = F.try_variant_get(v, "$", "array<variant>")
    listed = F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: scalar(x, True)), ", "), F.lit("]"))
    return F.when(items.isNotNull(), listed).otherwise(scalar(v, False))


def pipe_list(items: Column) -> Column:
    """Strings joined by ``|``, with backslashes and bars escaped."""
    escape = lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.array_join(F.transform(items, escape), "|")


def decode_pipe_list(encoded: str) -> list[str]:
    """The strings of a pipe list; the empty string is the empty list."""
    if not encoded:
        return []
    import re

    cells = re.findall(r"((?:[^\\|]|\\.?)*)(\||$)", encoded, re.S)
    out = []
    for cell, end in cells:
        out.append(re.sub(r"\\(.?)", r"\1", cell, flags=re.S))
        if not end:
            break
    return out


def flat(v: Column) -> Column:
    """A value as one cell: null empty, a list of scalars as a pipe list, other structures as JSON."""
    items = F.try_variant_get(v, "$", "array<variant>")
    nested = F.exists(items, lambda x: F.coalesce(kind(x).rlike("^(ARRAY|OBJECT)"), F.lit(False)))
    cell = lambda x: F.when(present(x), shown(x)).otherwise(F.lit(""))
    return (
        F.when(~present(v), F.lit(""))
        .when(items.isNotNull() & ~nested, pipe_list(F.transform(items, cell)))
        .when(kind(v).rlike("^(ARRAY|OBJECT)"), F.to_json(v))
        .otherwise(shown(v))
    )
