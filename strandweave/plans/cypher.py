"""A subset of Cypher, planned as joins.

``MATCH`` patterns of nodes and edges in both directions, typed or not, with property
maps and lengths as ``*1..3``, whose longest must be given; ``WHERE`` with comparisons, ``CONTAINS``, ``STARTS WITH``, ``ENDS WITH``, ``IN``,
``IS [NOT] NULL``, AND, OR, NOT; ``RETURN`` of nodes, properties and ``ID(x)``; ``ORDER BY``
properties or ids, ``SKIP`` and ``LIMIT``.  The result
is the graph induced by the nodes returned.  Patterns alone return all their variables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions import variants as V
from strandweave.model import PropertyGraph

_TOKEN = re.compile(
    r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+(?:\.\d+)?)|(?P<name>`[^`]+`|[A-Za-z_]\w*)|(?P<op><>|<=|>=|=~|->|<-|[-()\[\]{}:,.=<>|*]))""", re.X
)


class CypherError(ValueError):
    """A query that can't be read."""


@dataclass
class Node:
    var: str
    labels: list[str] = field(default_factory=list)
    props: dict = field(default_factory=dict)


@dataclass
class Edge:
    var: str
    types: list[str] = field(default_factory=list)
    props: dict = field(default_factory=dict)
    direction: str = "out"
    #: Fewest and most steps, for a path of variable length.
    hops: tuple[int, int] | None = None


def with_return(text: str) -> str:
    """Shorthand in full: a pattern alone gets MATCH and returns its named nodes."""
    if re.search(r"\bRETURN\b", text, re.I):
        return text
    if re.match(r"\s*MATCH\b", text, re.I):
        raise CypherError("a query with MATCH needs a RETURN")
    names = list(dict.fromkeys(re.findall(r"\((\w+)", text)))
    if not names:
        raise CypherError("the pattern names no node to return")
    return f"MATCH {text} RETURN {', '.join(names)}"


class Parser:
    """Recursive descent over the tokens of one query."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                if not text[at:].strip():
                    break
                raise CypherError(f"unexpected text at {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = self.unnamed = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1].upper() in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, *values: str) -> None:
        if not self.take(*values):
            found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise CypherError(f"expected {' or '.join(values)}, found {found}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1].strip("`")
        raise CypherError("expected a name")

    def literal(self):
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.at += 1
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "op" and text == "-":
            return -self.literal()
        if kind == "number":
            return float(text) if "." in text else int(text)
        if kind == "name" and text.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()]
        if kind == "op" and text == "[":
            items = []
            while not self.take("]"):
                items.append(self.literal())
                self.take(",")
            return items
        raise CypherError(f"expected a value, found {text or 'the end'}")

    def props(self) -> dict:
        found = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                found[key] = self.literal()
                self.take(",")
        return found

    def node(self) -> Node:
        self.need("(")
        var = self.name() if self.tokens[self.at][0] == "name" else self.fresh()
        labels = []
        while self.take(":"):
            labels.append(self.name())
        props = self.props()
        self.need(")")
        return Node(var, labels, props)

    def fresh(self) -> str:
        self.unnamed += 1
        return f"_u{self.unnamed}"

    def edge(self) -> Edge:
        back = self.take("<-")
        if not back:
            self.need("-")
        var, types, props, hops = self.fresh(), [], {}, None
        if self.take("["):
            if self.tokens[self.at][0] == "name":
                var = self.name()
            if self.take(":"):
                types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    types.append(self.name())
            hops = self.hops()
            props = self.props()
            self.need("]")
        if self.take("->"):
            if back:
                raise CypherError("an edge can't point both ways")
            return Edge(var, types, props, "out", hops)
        self.need("-")
        return Edge(var, types, props, "in" if back else "any", hops)

    def hops(self) -> tuple[int, int] | None:
        """``*n``, ``*m..n`` or ``*..n``."""
        if not self.take("*"):
            return None
        number = lambda: self.literal() if self.tokens[self.at][0] == "number" else None
        low = number()
        if not self.take("."):
            high = low
        else:
            self.need(".")
            low, high = 1 if low is None else low, number()
        if not isinstance(low, int) or not isinstance(high, int) or low > high:
            raise CypherError("a path of variable length needs its longest length, as in *1..3; expand walks further")
        return low, high

    def path(self):
        nodes, edges = [self.node()], []
        while self.peek("-", "<-"):
            edges.append(self.edge())
            nodes.append(self.node())
        return nodes, edges

    def query(self):
        self.need("MATCH")
        paths = [self.path()]
        while self.take(","):
            paths.append(self.path())
        condition = None
        if self.take("WHERE"):
            condition = self.either()
        self.need("RETURN")
        distinct = self.take("DISTINCT")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        order, skip, limit = [], None, None
        if self.take("ORDER"):
            self.need("BY")
            while not order or self.take(","):
                order.append((self.item(), self.take("DESC", "DESCENDING") or (self.take("ASC", "ASCENDING") and False)))
        if self.take("SKIP"):
            skip = self.literal()
        if self.take("LIMIT"):
            limit = self.literal()
        if self.at < len(self.tokens):
            raise CypherError(f"unexpected {self.tokens[self.at][1]} at the end")
        return paths, condition, items, distinct, order, skip, limit

    def item(self):
        if self.take("ID"):
            self.need("(")
            var = self.name()
            self.need(")")
            found = ("id", var)
        else:
            var = self.name()
            found = ("prop", var, self.name()) if self.take(".") else ("node", var)
        if self.take("AS"):
            self.name()
        return found

    def either(self):
        left = self.both()
        while self.take("OR"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("AND"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        if self.take("NOT"):
            return ("not", self.negated())
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        left = self.operand()
        for op in ("=", "<>", "<=", ">=", "<", ">", "CONTAINS", "IN", "=~"):
            if self.take(op):
                return ("test", op, left, self.operand())
        for op in ("STARTS", "ENDS"):
            if self.take(op):
                self.need("WITH")
                return ("test", op, left, self.operand())
        self.need("IS")
        absent = not self.take("NOT")
        self.need("NULL")
        return ("null", left, absent)

    def operand(self):
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "name" and text.upper() == "ID" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "(":
            return self.item()
        if kind == "name" and text.upper() not in ("TRUE", "FALSE", "NULL"):
            return self.item()
        return ("value", self.literal())


def _bind(g: PropertyGraph, node: Node) -> DataFrame:
    rows = g.entities
    if node.labels:
        rows = rows.where(F.arrays_overlap("types", F.array(*map(F.lit, node.labels))))
    for key, value in node.props.items():
        rows = rows.where(V.any_equals(F.col("props")[key], [value]))
    return rows.select(F.col("id").alias(f"{node.var}.id"), F.col("props").alias(f"{node.var}.props"))


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def _joined(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    condition = None
    for a, b in keys:
        one = _column(a) == _column(b)
        condition = one if condition is None else condition & one
    return left.join(right, condition)


def _unused(seen: list[str], ord_: Column) -> Column:
    """Whether an edge takes no part in the match so far."""
    out = F.lit(True)
    for other in seen:
        out = out & (~F.array_contains(_column(other), ord_) if other.endswith(".ords") else _column(other) != ord_)
    return out


def _walked(rows: DataFrame, e: DataFrame, start: str, edge: Edge, seen: list[str]) -> DataFrame:
    """Rows with the end ``_to`` of each path of the edge's lengths, and the path's edges; each edge occurs once."""
    out = e.select(F.col("src").alias("_from"), F.col("dst").alias("_next"), F.col("ord").alias("_ord"))
    turned = e.select(F.col("dst").alias("_from"), F.col("src").alias("_next"), F.col("ord").alias("_ord"))
    sides = out if edge.direction == "out" else turned if edge.direction == "in" else out.unionAll(turned.where("_from <> _next"))
    ords = f"{edge.var}.ords"
    front = rows.withColumn("_to", _column(start)).withColumn(ords, F.array().cast("array<bigint>"))
    low, high = edge.hops
    found = [front] if low == 0 else []
    for step in range(1, high + 1):
        joined = front.join(sides, F.col("_to") == F.col("_from")).where(_unused([*seen, ords], F.col("_ord")))
        front = joined.withColumn("_to", F.col("_next")).withColumn(ords, F.array_append(_column(ords), F.col("_ord"))).drop("_from", "_next", "_ord")
        if step >= low:
            found.append(front)
    return reduce(DataFrame.unionByName, found)


def match(g: PropertyGraph, paths) -> DataFrame:
    """A row for each match, with ``<var>.id`` and ``<var>.props`` for each node and edge.

    As a path is followed each edge joins what is bound already; a variable that occurs
    again must be the same node, and one edge takes part once in a match.
    """
    rows, bound, edges_seen = None, set(), []
    for nodes, edges in paths:
        first = nodes[0]
        if rows is None:
            rows = _bind(g, first)
            bound.add(first.var)
        elif first.var not in bound:
            raise CypherError(f"the path from ({first.var}) shares no node with the paths before it")
        elif first.labels or first.props:
            again = _bind(g, first).select(_column(f"{first.var}.id").alias("_again"))
            rows = rows.join(again, _column(f"{first.var}.id") == F.col("_again")).drop("_again")
        at = first
        for edge, node in zip(edges, nodes[1:], strict=True):
            e = g.relationships
            if edge.types:
                e = e.where(F.col("type").isin(edge.types))
            for key, value in edge.props.items():
                e = e.where(V.any_equals(F.col("props")[key], [value]))
            name = edge.var
            if edge.hops is not None:
                rows = _walked(rows, e, f"{at.var}.id", edge, edges_seen)
                edges_seen.append(f"{name}.ords")
                rows = rows.where(F.col("_to") == _column(f"{node.var}.id")).drop("_to") if node.var in bound else _joined(rows, _bind(g, node), [("_to", f"{node.var}.id")]).drop("_to")
                bound.add(node.var)
                at = node
                continue
            out = e.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.col("ord").alias(f"{name}.ord"), F.col("props").alias(f"{name}.props"))
            turned = e.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), F.col("ord").alias(f"{name}.ord"), F.col("props").alias(f"{name}.props"))
            sides = out if edge.direction == "out" else turned if edge.direction == "in" else out.unionAll(turned.where("_from <> _to"))
            rows = _joined(rows, sides, [(f"{at.var}.id", "_from")]).drop("_from")
            rows = rows.where(_unused(edges_seen, _column(f"{name}.ord")))
            edges_seen.append(f"{name}.ord")
            if node.var in bound:
                rows = rows.where(F.col("_to") == _column(f"{node.var}.id")).drop("_to")
            else:
                rows = _joined(rows, _bind(g, node), [("_to", f"{node.var}.id")]).drop("_to")
                bound.add(node.var)
            at = node
    return rows


def _operand(tree) -> tuple[str, Column]:
    if tree[0] == "value":
        v = tree[1]
        return "value", v
    if tree[0] == "id":
        return "text", _column(f"{tree[1]}.id")
    if tree[0] == "prop":
        return "variant", _column(f"{tree[1]}.props")[tree[2]]
    raise CypherError("a node itself can't be compared")


def _test(op: str, left, right) -> Column:
    (lk, lv), (rk, rv) = _operand(left), _operand(right)
    as_text = lambda k, v: F.lit(v).cast("string") if k == "value" else v if k == "text" else V.text_of(v)
    as_number = lambda k, v: F.lit(float(v)) if k == "value" else V.number_of(v)
    if op == "IN":
        return V.any_equals(lv, list(rv)) if lk == "variant" else as_text(lk, lv).isin(list(rv))
    if op in ("CONTAINS", "STARTS", "ENDS", "=~"):
        a, b = as_text(lk, lv), as_text(rk, rv)
        return {"CONTAINS": F.contains, "STARTS": F.startswith, "ENDS": F.endswith, "=~": lambda x, y: F.regexp_like(x, F.concat(F.lit("^(?:"), y, F.lit(")$")))}[op](a, b)
    if lk == "variant" and rk == "value" and op in ("=", "<>"):
        same = V.any_equals(lv, [rv])
        return same if op == "=" else V.present(lv) & ~same
    numeric = isinstance(rv if rk == "value" else lv if lk == "value" else None, (int, float)) or (lk == rk == "variant" and op not in ("=", "<>"))
    a, b = (as_number(lk, lv), as_number(rk, rv)) if numeric else (as_text(lk, lv), as_text(rk, rv))
    return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def condition(tree) -> Column:
    if tree[0] in ("and", "or"):
        a, b = condition(tree[1]), condition(tree[2])
        return a & b if tree[0] == "and" else a | b
    if tree[0] == "not":
        return ~F.coalesce(condition(tree[1]), F.lit(False))
    if tree[0] == "null":
        kind, v = _operand(tree[1])
        here = V.present(v) if kind == "variant" else v.isNotNull()
        return ~here if tree[2] else here
    return F.coalesce(_test(*tree[1:]), F.lit(False))


def matched_rows(g: PropertyGraph, text: str) -> tuple[DataFrame, list]:
    """The matches of a query and what it returns."""
    paths, where, items, _, order, skip, limit = Parser(with_return(text)).query()
    rows = match(g, paths)
    if where is not None:
        rows = rows.where(condition(where))
    known = {n.var for nodes, _ in paths for n in nodes}
    for item in [*items, *(x for x, _ in order)]:
        if item[1] not in known:
            raise CypherError(f"{item[1]!r} is not bound to a node")
    keys = []
    for item, down in order:
        kind, v = _operand(item)
        for c in (V.number_of(v), V.text_of(v)) if kind == "variant" else (v,):
            keys.append(c.desc_nulls_last() if down else c.asc_nulls_last())
    rows = rows.orderBy(*keys) if keys else rows
    rows = rows.offset(skip) if skip is not None else rows
    return (rows.limit(limit) if limit is not None else rows), items


def query(g: PropertyGraph, text: str) -> PropertyGraph:
    """The graph induced by the nodes that a query returns."""
    rows, items = matched_rows(g, text)
    names = list(dict.fromkeys(i[1] for i in items if i[0] in ("node", "id")))
    if not names:
        raise CypherError("the query returns properties only; return a node to get a graph")
    ids = rows.select(F.explode(F.array(*[_column(f"{n}.id") for n in names])).alias("id")).distinct()
    return g.induce(ids)
