"""A relational star schema as a graph.

Columns stay typed until a property is read: a map made of columns is taken apart again by
the optimiser, so a plan that reads one property reads one column of the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.model import PropertyGraph, no_props, props

#: The kinds of entities and relationships, so that a query over some of them reads no others.
ENTITIES = ("Customer", "Order", "Part", "Supplier", "Nation", "Region")
EDGES = ("placedBy", "contains", "suppliedBy", "inNation", "inRegion")
# the order of kinds, then of keys within a kind
_BASE = 1 << 48


_SCHEMAS: dict[str, object] = {}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A table's scan; its schema is taken from the files once."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def entities(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ENTITIES) -> DataFrame:
    read = lambda n: scan(spark, f"{sf_dir}/{n}.parquet")
    col = F.col

    def rows(i: int, df: DataFrame, prefix: str, key: str, types, columns: dict) -> DataFrame:
        return df.select(_id(prefix, key).alias("id"), (col(key).cast("bigint") + F.lit(i * _BASE)).alias("ord"), types.alias("types"), props(**columns).alias("props"), F.lit(df_name[prefix]).alias("source"))

    df_name = {"c": "customer", "o": "orders", "p": "part", "s": "supplier", "n": "nation", "r": "region"}
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    made = {
        "Customer": lambda i: rows(i, read("customer"), "c", "c_custkey", F.array(F.lit("Customer"), col("c_mktsegment")), {"name": col("c_name"), "acctbal": col("c_acctbal"), "segment": col("c_mktsegment"), "nation": col("c_nationkey")}),
        "Order": lambda i: rows(i, read("orders"), "o", "o_orderkey", F.array(F.lit("Order")), {"status": col("o_orderstatus"), "total": col("o_totalprice"), "date": date, "priority": col("o_orderpriority")}),
        "Part": lambda i: rows(i, read("part"), "p", "p_partkey", F.array(F.lit("Part"), col("p_brand")), {"name": col("p_name"), "brand": col("p_brand"), "kind": col("p_type"), "size": col("p_size"), "words": F.split("p_type", " ")}),
        "Supplier": lambda i: rows(i, read("supplier"), "s", "s_suppkey", F.array(F.lit("Supplier")), {"name": col("s_name"), "acctbal": col("s_acctbal")}),
        "Nation": lambda i: rows(i, read("nation"), "n", "n_nationkey", F.array(F.lit("Nation")), {"name": col("n_name")}),
        "Region": lambda i: rows(i, read("region"), "r", "r_regionkey", F.array(F.lit("Region")), {"name": col("r_name")}),
    }
    out = None
    for i, kind in enumerate(ENTITIES):
        if kind in kinds:
            one = made[kind](i)
            out = one if out is None else out.unionAll(one)
    return out


def relationships(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = EDGES) -> DataFrame:
    read = lambda n: scan(spark, f"{sf_dir}/{n}.parquet")
    col = F.col
    inline = F.lit(None).cast("string")

    def rows(df: DataFrame, ord_, src, dst, kind: str, p=None, rel_id=inline) -> DataFrame:
        return df.select(ord_.cast("bigint").alias("ord"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (no_props() if p is None else p).alias("props"), rel_id.alias("rel_id"))

    line = (col("l_orderkey") * 8 + col("l_linenumber"),)
    at = lambda i, c: c + F.lit(i * _BASE)
    line_props = props(quantity=col("l_quantity"), discount=col("l_discount"), shipdate=F.date_format("l_shipdate", "yyyy-MM-dd"))
    line_id = F.concat_ws("/", F.lit("line"), col("l_orderkey").cast("string"), col("l_linenumber").cast("string"))
    made = {
        "placedBy": lambda: [rows(read("orders"), at(0, col("o_orderkey")), _id("o", "o_orderkey"), _id("c", "o_custkey"), "placedBy")],
        "contains": lambda: [rows(read("lineitem"), at(1, line[0]), _id("o", "l_orderkey"), _id("p", "l_partkey"), "contains", line_props, line_id)],
        "suppliedBy": lambda: [rows(read("lineitem"), at(2, line[0]), _id("p", "l_partkey"), _id("s", "l_suppkey"), "suppliedBy", line_props)],
        "inNation": lambda: [rows(read("customer"), at(3, col("c_custkey")), _id("c", "c_custkey"), _id("n", "c_nationkey"), "inNation"), rows(read("supplier"), at(4, col("s_suppkey")), _id("s", "s_suppkey"), _id("n", "s_nationkey"), "inNation")],
        "inRegion": lambda: [rows(read("nation"), at(5, col("n_nationkey")), _id("n", "n_nationkey"), _id("r", "n_regionkey"), "inRegion")],
    }
    out = None
    for kind in EDGES:
        if kind in kinds:
            for one in made[kind]():
                out = one if out is None else out.unionAll(one)
    return out


def star(spark: SparkSession, sf_dir: str, entity_kinds: tuple[str, ...] = ENTITIES, edge_kinds: tuple[str, ...] = EDGES) -> PropertyGraph:
    """The graph of customers, orders, parts, suppliers, nations and regions, or of some kinds of them."""
    return PropertyGraph(entities(spark, sf_dir, entity_kinds), relationships(spark, sf_dir, edge_kinds), source="star")


def documents(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Documents as file entities without relationships; ``source`` is the document's own."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    e = d.select(_id("d", "doc_id").alias("id"), F.col("doc_id").alias("ord"), F.array(F.lit("File"), F.col("lang")).alias("types"), props(lang=F.col("lang"), n_chars=F.col("n_chars")).alias("props"), "source")
    empty = spark.createDataFrame([], "ord bigint, src string, dst string, type string, props map<string,variant>, rel_id string")
    return PropertyGraph(e, empty, source="documents")
