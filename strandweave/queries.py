"""Queries over the driver's tables, seen as a property graph, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import temporal
from strandweave.functions import variants as V
from strandweave.model import PropertyGraph, among, props
from strandweave.operators import analytics, annotate, communities, presentation, search, semantic, text, transforms
from strandweave.sinks import exports
from strandweave.sources import jsonld, rdf

from strandweave.sources.star import documents, scan, star

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The star graph in SQL: entities e, relationships r, neighbour pairs n.
STAR = """
e AS (
  SELECT 'c' || c_custkey AS id, c_custkey AS k, 0 AS o, ['Customer', c_mktsegment] AS types, 'customer' AS source FROM customer
  UNION ALL SELECT 'o' || o_orderkey, o_orderkey, 1, ['Order'], 'orders' FROM orders
  UNION ALL SELECT 'p' || p_partkey, p_partkey, 2, ['Part', p_brand], 'part' FROM part
  UNION ALL SELECT 's' || s_suppkey, s_suppkey, 3, ['Supplier'], 'supplier' FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, n_nationkey, 4, ['Nation'], 'nation' FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_regionkey, 5, ['Region'], 'region' FROM region
),
r AS (
  SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'placedBy' AS type, false AS reified FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'contains', true FROM lineitem
  UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'suppliedBy', false FROM lineitem
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'inNation', false FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'inNation', false FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'inRegion', false FROM nation
),
n AS (SELECT src AS id, dst AS nbr FROM r UNION SELECT dst, src FROM r)
"""
#: Rows of the graph induced by the ids in ``keep``.
INDUCED = """
SELECT 'entity' AS kind, id AS a, '' AS b, array_to_string(types, ', ') AS type FROM e WHERE id IN (SELECT id FROM keep)
UNION ALL SELECT 'relationship', src, dst, type FROM r WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)
"""


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL that gives the same rows."""

    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def induced(keep: str, more: str = "") -> str:
    return f"WITH {STAR}, {more}keep AS MATERIALIZED ({keep}) {INDUCED}"


def graph_rows(g: PropertyGraph) -> DataFrame:
    """A graph as rows: entities with their types, relationships with their ends."""
    e = g.entities.select(F.lit("entity").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.array_join("types", ", ").alias("type"))
    return e.unionAll(g.relationships.select(F.lit("relationship"), "src", "dst", "type"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet")


# -- filters ---------------------------------------------------------------------


@query("select_types", induced("SELECT id FROM e WHERE list_contains(types, 'Customer') OR list_contains(types, 'Nation')"))
def _(spark, d):
    return graph_rows(star(spark, d).select(entity_types=["Customer", "Nation"]))


@query("select_source", induced("SELECT id FROM e WHERE contains(source, 'ation') OR false"))
def _(spark, d):
    return graph_rows(star(spark, d).select(source="ation"))


@query("select_id", induced("SELECT id FROM e WHERE id = 'n7'"))
def _(spark, d):
    return graph_rows(star(spark, d).select(id="n7"))


@query("select_degree_range", induced("SELECT e.id FROM e LEFT JOIN (SELECT id, count(*) AS c FROM n GROUP BY id) d ON e.id = d.id WHERE coalesce(c, 0) BETWEEN 8 AND 40"))
def _(spark, d):
    return graph_rows(star(spark, d).select(min_connections=8, max_connections=40))


@query("select_rel_types", induced("SELECT src AS id FROM r WHERE type IN ('inRegion', 'inNation') UNION SELECT dst FROM r WHERE type IN ('inRegion', 'inNation')"))
def _(spark, d):
    return graph_rows(star(spark, d).select(relationship_types=["inRegion", "inNation"]))


@query("select_time_range", induced("SELECT 'o' || o_orderkey AS id FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1998"))
def _(spark, d):
    return graph_rows(star(spark, d).select(time_range=(1997, 1998)))


@query("select_combined", induced("SELECT e.id FROM e JOIN (SELECT id, count(*) AS c FROM n GROUP BY id) d ON e.id = d.id WHERE list_contains(types, 'Customer') AND c >= 12 AND e.id IN (SELECT src FROM r WHERE type = 'inNation')"))
def _(spark, d):
    return graph_rows(star(spark, d).select(entity_types="Customer", min_connections=12, relationship_types="inNation"))


_SPAN_SQL = """
SELECT 'o' || o_orderkey AS id FROM orders
WHERE year(o_orderdate) <= 1998 AND year(o_orderdate) + (o_orderkey % 3) >= 1998
"""


@query("time_range_overlap", _SPAN_SQL)
def _(spark, d):
    o = _table(spark, d, "orders")
    p = props(startDate=F.year("o_orderdate").cast("string"), endDate=(F.year("o_orderdate") + F.col("o_orderkey") % 3).cast("string"))
    return o.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), p.alias("props")).where(temporal.in_time_range(F.col("props"), 1998, 1998)).select("id")


_EXCLUDED = """kept AS (SELECT * FROM e WHERE NOT list_contains(types, 'Part')),
kr AS (SELECT * FROM r WHERE type NOT IN ('inRegion') AND src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)),
touched AS (SELECT src AS id FROM kr UNION SELECT dst FROM kr),
"""


def _exclude_sql(condition: str) -> str:
    return f"""WITH {STAR}, {_EXCLUDED} keep AS (SELECT id FROM kept WHERE {condition})
SELECT 'entity' AS kind, id AS a, '' AS b, array_to_string(types, ', ') AS type FROM kept WHERE id IN (SELECT id FROM keep)
UNION ALL SELECT 'relationship', src, dst, type FROM kr"""


@query("exclude_drop_isolated", _exclude_sql("id IN (SELECT id FROM touched) OR id NOT IN (SELECT id FROM n)"))
def _(spark, d):
    return graph_rows(star(spark, d).exclude(entity_types="Part", relationship_types="inRegion"))


@query("exclude_types_keep_isolates", _exclude_sql("true"))
def _(spark, d):
    return graph_rows(star(spark, d).exclude(entity_types="Part", relationship_types="inRegion", drop_isolated=False))


@query("drop_values", induced("SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT id FROM e WHERE id[1] IN ('n', 'r')"))
def _(spark, d):
    return graph_rows(star(spark, d, ("Customer", "Nation", "Region"), ("inNation", "inRegion")).drop(["BUILDING", "MACHINERY"]))


@query("drop_list_values", induced("SELECT 'p' || p_partkey AS id FROM part WHERE NOT list_contains(string_split(p_type, ' '), split_part((SELECT min(p_type) FROM part), ' ', 1)) UNION ALL SELECT id FROM e WHERE id[1] = 's'"))
def _(spark, d):
    word = _table(spark, d, "part").agg(F.min("p_type")).first()[0].split(" ")[0]
    return graph_rows(star(spark, d, ("Part", "Supplier"), ("suppliedBy",)).drop(word, property="words"))


@query("subtract_graph", induced("SELECT id FROM e WHERE id[1] IN ('c', 'n', 'r') AND NOT list_contains(types, 'BUILDING')"))
def _(spark, d):
    g = star(spark, d, ("Customer", "Nation", "Region"), ("inNation", "inRegion"))
    return graph_rows(g.subtract(g.select(entity_types="BUILDING")))


@query("where_equals", induced("SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7"))
def _(spark, d):
    return graph_rows(star(spark, d).where(segment="BUILDING", nation=7))


@query("where_range", induced("SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal BETWEEN 1000 AND 2500 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal BETWEEN 1000 AND 2500"))
def _(spark, d):
    return graph_rows(star(spark, d).where(acctbal=(1000, 2500)))


@query("where_list_member", induced("SELECT 'p' || p_partkey AS id FROM part WHERE list_contains(string_split(p_type, ' '), split_part((SELECT max(p_type) FROM part), ' ', 1))"))
def _(spark, d):
    word = _table(spark, d, "part").agg(F.max("p_type")).first()[0].split(" ")[0]
    return graph_rows(star(spark, d, ("Part", "Supplier"), ("suppliedBy",)).where(words=word))


@query("pattern_typed_edge", induced("SELECT id FROM m", "b AS MATERIALIZED (SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'),\nm AS MATERIALIZED (SELECT id FROM b WHERE id IN (SELECT 'c' || o_custkey FROM orders) UNION ALL SELECT 'o' || o_orderkey FROM orders JOIN b ON b.id = 'c' || o_custkey),\n"))
def _(spark, d):
    return graph_rows(star(spark, d).pattern("Order", via="placedBy", to_type="BUILDING"))


@query("expand_depth1", induced("SELECT id FROM s UNION SELECT nbr FROM n WHERE id IN (SELECT id FROM s)", "s AS (SELECT id FROM e WHERE id[1] = 'r'),\n"))
def _(spark, d):
    return graph_rows(star(spark, d).select(entity_types="Region").expand())


@query(
    "expand_depth2_via",
    induced("SELECT id FROM s2", "v AS (SELECT src AS id, dst AS nbr FROM r WHERE type IN ('inRegion', 'inNation') UNION SELECT dst, src FROM r WHERE type IN ('inRegion', 'inNation')),\ns AS (SELECT id FROM e WHERE id = 'r2'), s1 AS (SELECT id FROM s UNION SELECT nbr FROM v WHERE id IN (SELECT id FROM s)), s2 AS (SELECT id FROM s1 UNION SELECT nbr FROM v WHERE id IN (SELECT id FROM s1)),\n"),
)
def _(spark, d):
    return graph_rows(star(spark, d).select(id="r2").expand(2, via=["inRegion", "inNation"]))


@query("expand_typed", induced("SELECT id FROM s UNION SELECT nbr FROM n WHERE id IN (SELECT id FROM s) AND nbr[1] = 's'", "s AS (SELECT id FROM e WHERE id IN ('n3', 'n5')),\n"))
def _(spark, d):
    g = star(spark, d)
    return graph_rows(g.induce(g.entities.where("id IN ('n3', 'n5')")).expand(1, entity_types="Supplier"))


@query("cypher_one_hop", induced("SELECT id FROM m", "m AS (SELECT unnest([src, dst]) AS id FROM r WHERE type = 'inRegion'),\n"))
def _(spark, d):
    return graph_rows(star(spark, d).query("(a:Nation)-[:inRegion]->(b:Region)"))


@query(
    "cypher_two_hop_where",
    induced("SELECT id FROM m", "m AS (SELECT unnest(['o' || o_orderkey, 'n' || c_nationkey]) AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000 AND o_orderpriority = '1-URGENT' AND c_mktsegment LIKE 'B%'),\n"),
)
def _(spark, d):
    return graph_rows(star(spark, d).query("MATCH (o:Order)-[:placedBy]->(c:Customer)-[:inNation]->(n) WHERE c.acctbal > 9000 AND o.priority = '1-URGENT' AND c.segment STARTS WITH 'B' RETURN o, n"))


@query(
    "cypher_variable_length",
    induced("SELECT id FROM m", "m AS MATERIALIZED (SELECT unnest(['c' || c_custkey, 'n' || c_nationkey, 'r' || n_regionkey]) AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'),\n"),
)
def _(spark, d):
    return graph_rows(star(spark, d).query("MATCH (c:BUILDING)-[:inNation|inRegion*1..2]->(x) RETURN c, x"))


@query("cypher_order_limit", induced("SELECT 's' || s_suppkey AS id FROM (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 5 OFFSET 3)"))
def _(spark, d):
    return graph_rows(star(spark, d).query("MATCH (s:Supplier) RETURN s ORDER BY s.acctbal DESC, s.name SKIP 3 LIMIT 5"))


# -- degrees, joins, counts ------------------------------------------------------


@query("degree_topk", f"WITH {STAR} SELECT e.id, count(*) AS degree FROM e JOIN n ON e.id = n.id GROUP BY e.id, o, k ORDER BY degree DESC, o, k LIMIT 10")
def _(spark, d):
    return star(spark, d).most_connected(10).select("id", F.col("degree").cast("bigint").alias("degree"))


def flagship(spark, d):
    """The ten best connected entities of the star graph."""
    return star(spark, d).most_connected(10)


@query("neighbour_counts", f"WITH {STAR} SELECT e.id, CAST(count(n.nbr) AS BIGINT) AS degree FROM e LEFT JOIN n ON e.id = n.id GROUP BY e.id")
def _(spark, d):
    return star(spark, d).degrees().select("id", F.col("degree").cast("bigint").alias("degree"))


@query("related_join_names", "SELECT 'r' || r_regionkey AS id, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def _(spark, d):
    g = star(spark, d, ("Nation", "Region"), ("inRegion",)).annotate_entities(nations=lambda e: e.related("inRegion", "in").join("name"))
    return g.entities.where("startswith(id, 'r')").select("id", V.text_of(F.col("props")["nations"]).alias("nations"))


@query("has_related", "SELECT 'c' || c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS n FROM customer")
def _(spark, d):
    g = star(spark, d, ("Customer", "Order"), ("placedBy",))
    urgent = PropertyGraph(g.entities, among(g.relationships, g.entities.where(V.equals(F.col("props")["priority"], "1-URGENT")).select("id"), "src"))
    made = urgent.annotate_entities(urgent=lambda e: e.has("placedBy", "in"), n=lambda e: e.related("placedBy", "in").count())
    p = F.col("props")
    return made.entities.where("startswith(id, 'c')").select("id", F.try_variant_get(p["urgent"], "$", "boolean").alias("urgent"), F.try_variant_get(p["n"], "$", "bigint").alias("n"))


@query("related_first", "SELECT 'c' || o_custkey AS id, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY o_custkey")
def _(spark, d):
    made = star(spark, d, ("Customer", "Order"), ("placedBy",)).annotate_entities(first_priority=lambda e: e.related("placedBy", "in").first("priority"))
    return made.entities.where("startswith(id, 'c') AND map_contains_key(props, 'first_priority')").select("id", V.text_of(F.col("props")["first_priority"]).alias("first_priority"))


_LISTS_SQL = """SELECT 'c' || c_custkey AS id, coalesce(string_agg(o_orderpriority, '; ' ORDER BY o_orderkey), 'none') AS in_order,
CAST(list(CAST(floor(o_totalprice) AS BIGINT) ORDER BY floor(o_totalprice)) FILTER (o_orderkey IS NOT NULL) AS VARCHAR) AS totals,
coalesce(list_distinct(list(o_orderstatus ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL)).len(), 0) AS n_statuses FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""


@query("related_lists", _LISTS_SQL)
def _(spark, d):
    g = star(spark, d, ("Customer", "Order"), ("placedBy",))
    orders = lambda e: e.related("placedBy", "in")
    made = g.annotate_entities(
        in_order=lambda e: orders(e).join("priority", "; ", unique=False, sort=False, default="none"),
        totals=lambda e: orders(e).list(lambda o: F.floor(o.number("total")), sort=True),
        statuses=lambda e: orders(e).list("status", unique=True),
    )
    p = F.col("props")
    listed = F.transform(V.elements(p["totals"]), V.text_of)
    totals = F.when(F.size(listed) > 0, F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")))
    return made.entities.where("startswith(id, 'c')").select("id", V.text_of(p["in_order"]).alias("in_order"), totals.alias("totals"), F.size(V.elements(p["statuses"])).cast("bigint").alias("n_statuses"))


@query("annotate_relationships", "SELECT 'n' || n_nationkey AS src, n_name || ' in ' || r_name AS sentence FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    made = star(spark, d, ("Nation", "Region"), ("inRegion",)).annotate_relationships(sentence=lambda r: F.concat(r.source.text("name"), F.lit(" in "), r.target.text("name")))
    return made.relationships.select("src", V.text_of(F.col("props")["sentence"]).alias("sentence"))


@query("entity_counts_types", f"WITH {STAR} SELECT t AS types, count(*) AS count FROM (SELECT unnest(types) AS t FROM e) GROUP BY t")
def _(spark, d):
    return star(spark, d).entity_counts("types")


@query("entity_counts_list", "SELECT w AS words, count(*) AS count FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY w")
def _(spark, d):
    counted = star(spark, d, ("Part",), ("suppliedBy",)).entity_counts("words")
    return counted.select(V.text_of(F.col("words")).alias("words"), "count")


@query("relationship_counts_field", f"WITH {STAR} SELECT type, count(*) AS count FROM r GROUP BY type")
def _(spark, d):
    return star(spark, d).relationship_counts("type")


@query("relationship_counts_property", "SELECT CAST(l_quantity AS BIGINT) AS quantity, count(*) AS count FROM lineitem GROUP BY 1")
def _(spark, d):
    return star(spark, d, ("Order", "Part"), ("contains",)).relationship_counts("quantity").select(F.try_variant_get("quantity", "$", "bigint").alias("quantity"), "count")


@query("counts_json_value", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS count FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 1")
def _(spark, d):
    ev = _table(spark, d, "events")
    e = ev.select(F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("ord"), F.array("event_type").alias("types"), F.from_json("props", "map<string,variant>").alias("props"), F.lit(None).cast("string").alias("source"))
    empty = spark.createDataFrame([], "ord bigint, src string, dst string, type string, props map<string,variant>, rel_id string")
    return PropertyGraph(e, empty).entity_counts("k").select(F.try_variant_get("k", "$", "bigint").alias("k"), "count")


@query("entity_records", "SELECT 's' || s_suppkey AS id, s_name AS label, 'Supplier' AS type, s_name AS name, CAST(s_acctbal AS DOUBLE) AS acctbal, CAST(NULL AS VARCHAR) AS missing FROM supplier")
def _(spark, d):
    r = star(spark, d, ("Supplier",), ("suppliedBy",)).entity_records(["id", "label", "type", "name", "acctbal", "missing"])
    return r.select("id", "label", "type", V.text_of(F.col("name")).alias("name"), V.number_of(F.col("acctbal")).alias("acctbal"), V.text_of(F.col("missing")).alias("missing"))


@query("relationship_records", "SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'inRegion' AS type, CAST(NULL AS VARCHAR) AS rel_id FROM nation")
def _(spark, d):
    return star(spark, d, ("Nation", "Region"), ("inRegion",)).relationship_records(["source", "target", "type", "rel_id"])


# -- analytics -------------------------------------------------------------------


@query("graph_summary", f"WITH {STAR} SELECT 'entity' AS kind, array_to_string(types, ', ') AS type, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'relationship', type, count(*) FROM r GROUP BY 2")
def _(spark, d):
    return analytics.type_counts(star(spark, d))


_SPARSE = """e AS (SELECT 'o' || o_orderkey AS id, 'Order' AS t FROM orders UNION ALL SELECT 'p' || p_partkey, 'Part' FROM part),
r AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_quantity = 50 AND l_discount >= 0.09),
n AS (SELECT src AS id, dst AS nbr FROM r UNION SELECT dst, src FROM r),
d AS (SELECT e.id, e.t, count(n.nbr) AS g FROM e LEFT JOIN n ON e.id = n.id GROUP BY 1, 2)"""


def sparse(spark: SparkSession, d: str) -> PropertyGraph:
    """Orders and parts with the few edges of large discounted quantities."""
    g = star(spark, d, ("Order", "Part"), ("contains",))
    p = F.col("props")
    return PropertyGraph(g.entities, g.relationships.where((V.number_of(p["quantity"]) == 50) & (V.number_of(p["discount"]) >= 0.09)))


_COMPONENTS = f"""WITH RECURSIVE {_SPARSE},
walk(id, node) AS (SELECT id, id FROM n UNION SELECT w.id, n.nbr FROM walk w JOIN n ON w.node = n.id),
c AS (SELECT id, min(node) AS component FROM walk GROUP BY id),
every AS (SELECT e.id, coalesce(component, e.id) AS component FROM e LEFT JOIN c ON e.id = c.id)
"""


@query("components", _COMPONENTS + "SELECT id, component FROM every")
def _(spark, d):
    return analytics.components(sparse(spark, d))


@query("component_sizes", _COMPONENTS + "SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM every GROUP BY component) GROUP BY size")
def _(spark, d):
    sizes = analytics.components(sparse(spark, d)).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n"))


@query(
    "graph_profile",
    _COMPONENTS
    + """, s AS (SELECT avg(g) AS m, stddev_pop(g) AS sd FROM d),
mult AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS c FROM r GROUP BY 1, 2)
SELECT (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM r) AS relationships,
  round((SELECT count(*) FROM r) / ((SELECT count(*) FROM e) * ((SELECT count(*) FROM e) - 1.0)) * 1e6, 6) AS density_ppm,
  (SELECT count(DISTINCT t) FROM e) AS entity_types, (SELECT count(*) FROM e WHERE t = 'Order') / CAST((SELECT count(*) FROM e) AS DOUBLE) AS top_type_fraction,
  (SELECT count(DISTINCT component) FROM every) AS components, (SELECT max(g) FROM d) AS degree_max, round((SELECT m FROM s), 6) AS degree_mean,
  CAST((SELECT median(g) FROM d) AS DOUBLE) AS degree_median, round((SELECT avg(pow(g - m, 3)) / pow(max(sd), 3) FROM d, s), 6) AS degree_skewness,
  (SELECT max(c) FROM mult) AS multiplicity_max, (SELECT count(*) FROM d WHERE g = 0) AS isolates""",
)
def _(spark, d):
    p = sparse(spark, d).profile()
    return p.select(
        "entities", "relationships", F.round(F.col("density") * 1e6, 6).alias("density_ppm"), "entity_types", "top_type_fraction", "components", F.col("degree_max").cast("bigint").alias("degree_max"),
        F.round("degree_mean", 6).alias("degree_mean"), F.col("degree_median").cast("double").alias("degree_median"), F.round("degree_skewness", 6).alias("degree_skewness"), "multiplicity_max", "isolates",
    )


@query(
    "coverage_pairs",
    f"""WITH {STAR}, t AS (SELECT r.type, s.types[1] AS st, x.types[1] AS dt, r.reified, r.src, r.dst FROM r JOIN e s ON r.src = s.id JOIN e x ON r.dst = x.id),
p AS (SELECT type, st, dt, reified, count(*) AS occurrences, count(DISTINCT src) AS ns, count(DISTINCT dst) AS nd FROM t GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5),
k AS (SELECT types[1] AS t, count(*) AS total FROM e GROUP BY 1),
u AS (SELECT *, 'source' AS side, st AS entity_type, ns AS reached FROM p UNION ALL SELECT *, 'target', dt, nd FROM p)
SELECT type AS relationship_type, st AS source_type, dt AS target_type, reified, occurrences, side, entity_type, reached, total, round(reached / CAST(total AS DOUBLE), 6) AS fraction FROM u JOIN k ON u.entity_type = k.t""",
)
def _(spark, d):
    return star(spark, d).coverage(inline_relations=True).withColumn("fraction", F.round("fraction", 6))


@query("edge_multiplicity", f"WITH {STAR}, m AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS c FROM r GROUP BY 1, 2) SELECT max(CASE WHEN a <> b THEN c END) AS multiplicity_max, round(avg(CASE WHEN a <> b THEN c END), 6) AS multiplicity_mean, CAST(coalesce(sum(CASE WHEN a = b THEN c END), 0) AS BIGINT) AS self_loops FROM m")
def _(spark, d):
    return analytics.multiplicity(star(spark, d)).withColumn("multiplicity_mean", F.round("multiplicity_mean", 6))


@query("isolates", "SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def _(spark, d):
    return star(spark, d, ("Order", "Part"), ("contains",)).degrees().where("degree = 0").select("id")


@query("type_adjacency", f"WITH {STAR} SELECT least(s.types[1], x.types[1]) AS a, greatest(s.types[1], x.types[1]) AS b, count(*) AS n FROM r JOIN e s ON r.src = s.id JOIN e x ON r.dst = x.id GROUP BY 1, 2")
def _(spark, d):
    return analytics.type_adjacency(star(spark, d))


@query("cap_top_nodes", induced("SELECT id FROM (SELECT e.id, count(n.nbr) AS c, o, k FROM e LEFT JOIN n ON e.id = n.id GROUP BY 1, 3, 4 ORDER BY c DESC, o, k LIMIT 300)"))
def _(spark, d):
    return graph_rows(analytics.cap_most_connected(star(spark, d), 300))


@query("corpus_statistics", "SELECT 'entities' AS measure, CAST(min(c) AS DOUBLE) AS min, CAST(max(c) AS DOUBLE) AS max, CAST(median(c) AS DOUBLE) AS median FROM (SELECT count(*) AS c FROM customer GROUP BY c_nationkey)")
def _(spark, d):
    per = _table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("entities")).select("entities")
    return analytics.corpus_statistics(per)


# -- transforms ------------------------------------------------------------------


def _edges_of(g: PropertyGraph) -> DataFrame:
    return g.relationships.select("src", "dst", "type", V.number_of(F.col("props")["weight"]).cast("bigint").alias("weight"))


def _merge_sql(group: str, kind: str) -> str:
    by = "sg, dg, type" if kind == "type" else "sg, dg"
    return f"""WITH {STAR}, g AS (SELECT id, {group} AS g FROM e), x AS (SELECT a.g AS sg, b.g AS dg, type FROM r JOIN g a ON r.src = a.id JOIN g b ON r.dst = b.id WHERE a.g <> b.g)
SELECT sg AS src, dg AS dst, {kind} AS type, count(*) AS weight FROM x GROUP BY {by}"""


@query("merge_by_type", _merge_sql("array_to_string(types, ', ')", "type"))
def _(spark, d):
    return _edges_of(star(spark, d).merge_nodes("type"))


@query("merge_primary", _merge_sql("types[1]", "'merged'"))
def _(spark, d):
    return _edges_of(star(spark, d).merge_by_primary_type())


@query("merge_by_property", "WITH g AS (SELECT 'c' || c_custkey AS id, c_mktsegment AS g FROM customer UNION ALL SELECT 'n' || n_nationkey, '(no value)' FROM nation), r AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer) SELECT a.g AS src, b.g AS dst, 'inNation' AS type, count(*) AS weight FROM r JOIN g a ON src = a.id JOIN g b ON dst = b.id WHERE a.g <> b.g GROUP BY 1, 2")
def _(spark, d):
    return _edges_of(star(spark, d, ("Customer", "Nation"), ("inNation",)).merge_nodes("segment"))


@query("merge_group_sizes", "SELECT c_mktsegment AS id, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    g = star(spark, d, ("Customer",), ("inNation",)).merge_nodes("segment")
    return g.entities.select("id", F.try_variant_get(F.col("props")["count"], "$", "bigint").alias("n"))


@query(
    "collapse_parallel_edges",
    """WITH r AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'contains' AS type FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'suppliedBy' FROM lineitem),
g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, any_value(src) AS s, any_value(dst) AS t, count(*) AS n, any_value(type) AS type FROM r GROUP BY 1, 2)
SELECT s AS src, t AS dst, type, n, n > 1 AS collapsed FROM g""",
)
def _(spark, d):
    g = star(spark, d, ("Order", "Part", "Supplier"), ("contains", "suppliedBy")).collapse_edges()
    p = F.col("props")
    return g.relationships.select("src", "dst", "type", F.coalesce(F.try_variant_get(p["count"], "$", "bigint"), F.lit(1)).alias("n"), F.coalesce(F.try_variant_get(p["collapsed"], "$", "boolean"), F.lit(False)).alias("collapsed"))


_CORE = """e AS (SELECT 'c' || c_custkey AS id, 'Customer' AS t FROM customer UNION ALL SELECT DISTINCT strftime(o_orderdate, 'm%Y-%m'), 'Month' FROM orders WHERE o_orderpriority = '1-URGENT'),
r AS (SELECT 'c' || o_custkey AS src, strftime(o_orderdate, 'm%Y-%m') AS dst FROM orders WHERE o_orderpriority = '1-URGENT'),
n0 AS (SELECT src AS id, dst AS nbr FROM r UNION SELECT dst, src FROM r)"""


def _core_sql(k: int, rounds: int = 12) -> str:
    parts = [_CORE]
    for i in range(rounds):
        parts.append(f"k{i} AS (SELECT id FROM n{i} GROUP BY id HAVING count(*) >= {k})")
        parts.append(f"n{i + 1} AS MATERIALIZED (SELECT id, nbr FROM n{i} WHERE id IN (SELECT id FROM k{i}) AND nbr IN (SELECT id FROM k{i}))")
    parts.append(f"core AS (SELECT id FROM n{rounds} GROUP BY id HAVING count(*) >= {k})")
    return "WITH " + ",\n".join(parts)


def customer_months(spark: SparkSession, d: str, priority: str | None = "1-URGENT") -> PropertyGraph:
    """Customers and the months in which they placed orders of a priority, or any."""
    rows = _table(spark, d, "orders")
    o = (rows if priority is None else rows.where(F.col("o_orderpriority") == priority)).select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("m"), F.date_format("o_orderdate", "yyyy-MM")).alias("dst"))
    none, empty = F.lit(None).cast("string"), props()
    c = _table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_custkey").cast("bigint").alias("ord"), F.array(F.lit("Customer")).alias("types"), empty.alias("props"), none.alias("source"))
    m = o.groupBy(F.col("dst").alias("id")).agg(F.min("ord").alias("ord")).select("id", "ord", F.array(F.lit("Month")).alias("types"), empty.alias("props"), none.alias("source"))
    return PropertyGraph(c.unionAll(m), o.select("ord", "src", "dst", F.lit("orderedIn").alias("type"), empty.alias("props"), none.alias("rel_id")))


@query("kcore_k3", _core_sql(3) + " SELECT id FROM core")
def _(spark, d):
    return transforms.peel(customer_months(spark, d), 3)[0]


@query("kcore_removed_summary", _core_sql(4) + ", x AS (SELECT n0.id, e.t FROM n0 JOIN e ON n0.nbr = e.id WHERE n0.id IN (SELECT id FROM core) AND n0.nbr NOT IN (SELECT id FROM core)) SELECT c.id, CAST(count(x.t) AS BIGINT) AS lost FROM core c LEFT JOIN x ON c.id = x.id GROUP BY c.id")
def _(spark, d):
    g = customer_months(spark, d).simplify(4)
    lost = F.coalesce(F.try_variant_get(F.col("props")["simplified"], "$.Customer", "bigint"), F.lit(0)) + F.coalesce(F.try_variant_get(F.col("props")["simplified"], "$.Month", "bigint"), F.lit(0))
    return g.entities.select("id", lost.alias("lost"))


# -- dates -----------------------------------------------------------------------

_MESSY = """CASE o_orderkey % 9
WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN 'c.' || strftime(o_orderdate, '%Y')
WHEN 3 THEN strftime(o_orderdate, '%Y') || '?' WHEN 4 THEN strftime(o_orderdate, '%Y')[1:3] || '0s' WHEN 5 THEN strftime(o_orderdate, '%Y') || '-' || (year(o_orderdate) + 2)
WHEN 6 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 7 THEN strftime(o_orderdate, '%b %Y') ELSE 'see notes' END"""
_MESSY_VALUES = """CASE o_orderkey % 9 WHEN 0 THEN 'day' WHEN 1 THEN 'year' WHEN 2 THEN 'year' WHEN 3 THEN 'year' WHEN 4 THEN 'decade' WHEN 5 THEN 'year' WHEN 6 THEN 'day' WHEN 7 THEN 'month' END"""


def messy_dates(spark: SparkSession, d: str) -> DataFrame:
    """``(o_orderkey, o_orderdate, messy)``: order dates written in nine ways."""
    o = _table(spark, d, "orders")
    year, k = F.date_format("o_orderdate", "yyyy"), F.col("o_orderkey") % 9
    forms = [F.date_format("o_orderdate", "yyyy-MM-dd"), year, F.concat(F.lit("c."), year), F.concat(year, F.lit("?")), F.concat(F.substring(year, 1, 3), F.lit("0s")), F.concat(year, F.lit("-"), (F.year("o_orderdate") + 2).cast("string")), F.date_format("o_orderdate", "d MMMM yyyy"), F.date_format("o_orderdate", "MMM yyyy"), F.lit("see notes")]
    messy = forms[8]
    for i in range(8):
        messy = F.when(k == i, forms[i]).otherwise(messy)
    return o.select("o_orderkey", "o_orderdate", messy.alias("messy"))


_DATES_SQL = f"""WITH m AS (SELECT o_orderkey, o_orderdate, year(o_orderdate) AS y, o_orderkey % 9 AS f, {_MESSY_VALUES} AS p FROM orders)
SELECT o_orderkey, strftime(CASE p WHEN 'day' THEN CAST(o_orderdate AS DATE) WHEN 'month' THEN make_date(y, month(o_orderdate), 1) WHEN 'decade' THEN make_date(y - y % 10, 1, 1) WHEN 'year' THEN make_date(y, 1, 1) END, '%Y-%m-%d') AS start_date,
strftime(CASE p WHEN 'day' THEN CAST(o_orderdate AS DATE) WHEN 'month' THEN last_day(o_orderdate) WHEN 'decade' THEN make_date(y - y % 10 + 9, 12, 31) WHEN 'year' THEN make_date(CASE WHEN f = 5 THEN y + 2 ELSE y END, 12, 31) END, '%Y-%m-%d') AS end_date,
CAST(CASE WHEN p = 'decade' THEN y - y % 10 WHEN p IS NOT NULL THEN y END AS INTEGER) AS year, p AS date_precision, CASE WHEN p IS NOT NULL THEN f = 2 END AS date_circa, CASE WHEN p IS NOT NULL THEN f = 3 END AS date_uncertain FROM m WHERE p IS NOT NULL"""


@query("convert_dates_columns", _DATES_SQL)
def _(spark, d):
    rows = messy_dates(spark, d)
    e = rows.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("ord"), F.array(F.lit("Order")).alias("types"), props(date=F.col("messy")).alias("props"), F.lit(None).cast("string").alias("source"))
    g = PropertyGraph(e, star(spark, d, (), ("inRegion",)).relationships.where(F.lit(False))).convert_dates()
    p = F.col("props")
    text_, flag = (lambda k: V.text_of(p[k]).alias(k)), (lambda k: F.try_variant_get(p[k], "$", "boolean").alias(k))
    dated = g.entities.where(F.map_contains_key("props", "year"))
    return dated.select(F.col("ord").alias("o_orderkey"), text_("start_date"), text_("end_date"), F.try_variant_get(p["year"], "$", "int").alias("year"), text_("date_precision"), flag("date_circa"), flag("date_uncertain"))


@query("date_precision_counts", f"SELECT coalesce({_MESSY_VALUES}, 'none') AS date_precision, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return messy_dates(spark, d).groupBy(F.coalesce(temporal.parse(F.col("messy"))["precision"], F.lit("none")).alias("date_precision")).agg(F.count("*").alias("n"))


@query("date_range_strings", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS first_year, CAST(year(o_orderdate) + 2 AS INTEGER) AS last_year FROM orders WHERE o_orderkey % 9 = 5")
def _(spark, d):
    t = messy_dates(spark, d).withColumn("t", temporal.parse(F.col("messy"))).where("t.is_range")
    return t.select("o_orderkey", F.year("t.start").alias("first_year"), F.year("t.end").alias("last_year"))


@query("decade_uncertain", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 9 = 4 THEN year(o_orderdate) - year(o_orderdate) % 10 ELSE year(o_orderdate) END AS INTEGER) AS year FROM orders WHERE o_orderkey % 9 IN (3, 4)")
def _(spark, d):
    t = messy_dates(spark, d).withColumn("t", temporal.parse(F.col("messy"))).where("t.uncertain OR t.precision = 'decade'")
    return t.select("o_orderkey", "t.year")


# -- texts and nearest neighbours ------------------------------------------------


@query("property_text_records", "SELECT 's' || s_suppkey AS entity_id, 'supplier' AS source_id, '[Supplier]' || chr(10) || 'name: ' || s_name AS text FROM supplier")
def _(spark, d):
    return star(spark, d, ("Supplier",), ("suppliedBy",)).text_records(source_kind="properties", text_properties=["name"]).select("entity_id", "source_id", "text")


def document_records(spark: SparkSession, d: str) -> DataFrame:
    """Text records of the documents' files."""
    files = _table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    return documents(spark, d).text_records(source_kind="file", files=files)


@query("text_record_filters", "SELECT 'd' || doc_id AS entity_id, source AS source_id, md5(text) AS text_md5 FROM documents WHERE lang IN ('fr', 'de') AND source IN ('src1', 'src2', 'src3') AND trim(text) <> ''")
def _(spark, d):
    r = text.apply_filters(document_records(spark, d), {"entity_types": ["fr", "de"], "source_id": ["src1", "src2", "src3"]})
    return r.select("entity_id", "source_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_CHUNKS = r"""WITH t AS (SELECT 'd' || doc_id AS entity_id, regexp_extract_all(text, '\w+|[^\w\s]') AS w FROM documents WHERE trim(text) <> ''),
c AS (SELECT entity_id, w, len(w) AS n, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 300 THEN 1 ELSE CAST(ceil((len(w) - 300) / 250.0) AS BIGINT) + 1 END)) AS i FROM t)
"""


@query("text_chunks", _CHUNKS + "SELECT entity_id, CAST(i AS INTEGER) AS chunk_index, CAST(least(i * 250 + 300, n) - i * 250 AS INTEGER) AS tokens FROM c")
def _(spark, d):
    return text.chunks(document_records(spark, d)).select("entity_id", "chunk_index", "tokens")


@query("chunk_reconstruct", _CHUNKS + "SELECT entity_id, CAST(i AS INTEGER) AS chunk_index, md5(array_to_string(w[i * 250 + 1 : least(i * 250 + 300, n)], ' ')) AS words_md5 FROM c")
def _(spark, d):
    c = text.chunks(document_records(spark, d))
    return c.select("entity_id", "chunk_index", F.md5(F.array_join(F.regexp_extract_all("chunk", F.lit(text.TOKEN), F.lit(0)), " ").cast("binary")).alias("words_md5"))


@query(
    "source_hash_diff",
    "SELECT source AS source_id, CASE WHEN source = 'src1' THEN 'removed' WHEN source = 'src2' THEN 'new' WHEN max(CASE WHEN doc_id % 97 = 3 THEN 1 ELSE 0 END) = 1 THEN 'changed' ELSE 'unchanged' END AS state FROM documents GROUP BY source",
)
def _(spark, d):
    now = document_records(spark, d)
    new = semantic.source_hashes(now.where("source_id <> 'src1'"))
    key = F.substring("entity_id", 2, 20).cast("bigint")
    old = now.where("source_id <> 'src2'").withColumn("text", F.when(key % 97 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return semantic.source_diff(new, semantic.source_hashes(old))


def _probe(spark: SparkSession, d: str) -> list[float]:
    return list(_table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


_DISTANCE = "sqrt(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))))"


@query("knn_topk", f"SELECT vec_id, round({_DISTANCE}, 6) AS distance FROM embeddings ORDER BY {_DISTANCE}, vec_id LIMIT 10")
def _(spark, d):
    return semantic.nearest(_table(spark, d, "embeddings"), _probe(spark, d), 10, ["vec_id"]).select("vec_id", F.round("distance", 6).alias("distance"))


@query("knn_filtered", f"SELECT vec_id, round(1 / (1 + {_DISTANCE}), 6) AS score FROM embeddings WHERE label IN (3, 5) ORDER BY {_DISTANCE}, vec_id LIMIT 10")
def _(spark, d):
    rows = _table(spark, d, "embeddings").where("label IN (3, 5)")
    return semantic.nearest(rows, _probe(spark, d), 10, ["vec_id"]).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_entity_rollup", f"WITH h AS (SELECT vec_id, {_DISTANCE} AS dist FROM embeddings ORDER BY dist, vec_id LIMIT 50) SELECT 'g' || (vec_id % 37) AS entity_id, round(max(1 / (1 + dist)), 6) AS score FROM h GROUP BY 1 ORDER BY max(1 / (1 + dist)) DESC, 1 LIMIT 10")
def _(spark, d):
    rows = _table(spark, d, "embeddings").withColumn("entity_id", F.concat(F.lit("g"), F.col("vec_id") % 37))
    hits = semantic.nearest(rows, _probe(spark, d), 50, ["vec_id"])
    return semantic.entity_scores(hits, 10).select("entity_id", F.round("score", 6).alias("score"))


# -- sources and sinks -----------------------------------------------------------


@query("multi_source_union", "SELECT 'one/n' || n_nationkey AS id, 'n' || n_nationkey AS raw_id FROM nation UNION ALL SELECT 'two/n' || n_nationkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'two/r' || r_regionkey, 'r' || r_regionkey FROM region")
def _(spark, d):
    g = jsonld.union({"one": star(spark, d, ("Nation",), ("inRegion",)), "two": star(spark, d, ("Nation", "Region"), ("inRegion",))})
    return g.entities.select("id", V.text_of(F.col("props")["raw_id"]).alias("raw_id"))


@query("referential_check", "SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def _(spark, d):
    from strandweave.model import checked

    g = star(spark, d, ("Order", "Part"), ("contains",))
    known = g.entities.where(~F.coalesce(V.equals(F.col("props")["status"], "F"), F.lit(False)))
    return checked(known, g.relationships)[1].groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("dangling_links", r"WITH l AS (SELECT url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT url AS src, href AS dst, count(*) AS n FROM l WHERE href NOT IN (SELECT url FROM pages WHERE url IS NOT NULL) GROUP BY 1, 2")
def _(spark, d):
    pages = _table(spark, d, "pages")
    links = pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))
    return links.join(pages.select(F.col("url").alias("dst")), "dst", "left_anti").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("reply_chains", "SELECT conv_id || '/' || turn AS src, conv_id || '/' || (turn - 1) AS dst FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)")
def _(spark, d):
    from strandweave.model import checked

    c = _table(spark, d, "conversations")
    name = lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    e = c.select(name(F.col("turn")).alias("id"))
    r = c.select(F.col("turn").alias("ord"), name(F.col("turn")).alias("src"), name(F.col("turn") - 1).alias("dst"), F.lit("replyTo").alias("type"), props().alias("props"), F.lit(None).cast("string").alias("rel_id"))
    return checked(e, r)[0].select("src", "dst")


@query("flatten_nodes", "SELECT 'p' || p_partkey AS id, 'Part|' || p_brand AS types, replace(p_type, ' ', '|') AS words, CAST(p_size AS VARCHAR) AS size FROM part")
def _(spark, d):
    return exports.flat_nodes(star(spark, d, ("Part",), ("suppliedBy",))).select("id", "types", "words", "size")


@query("pipe_list_encode", r"SELECT p_partkey, replace(replace(p_name, '\', '\\'), '|', '\|') || '|' || replace('a|b\c', '\', '\\').replace('|', '\|') AS cell FROM part")
def _(spark, d):
    return _table(spark, d, "part").select("p_partkey", V.pipe_list(F.array(F.col("p_name"), F.lit("a|b\\c"))).alias("cell"))


@query("edge_widths", "SELECT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, 'contains' AS type, round(1 + 2 * ln(1 + l_quantity), 6) AS width FROM lineitem")
def _(spark, d):
    g = star(spark, d, ("Order", "Part"), ("contains",))
    weighted = PropertyGraph(g.entities, g.relationships.withColumn("props", F.create_map(F.lit("weight"), F.col("props")["quantity"])))
    return presentation.edge_payload(weighted).withColumn("width", F.round("width", 6))


@query("node_sizes", f"WITH {STAR}, d AS (SELECT e.id, e.types[1] AS t, count(n.nbr) AS g FROM e LEFT JOIN n ON e.id = n.id WHERE e.id[1] IN ('n', 'r') AND (n.nbr IS NULL OR n.nbr[1] IN ('n', 'r')) GROUP BY 1, 2) SELECT id, t AS type, round(3 + 17 * sqrt(g / CAST((SELECT max(g) FROM d) AS DOUBLE)), 6) AS size FROM d")
def _(spark, d):
    g = star(spark, d, ("Nation", "Region"), ("inRegion",))
    return presentation.node_payload(g).select("id", "type", F.round("size", 6).alias("size"))


# -- without SQL: tested against brute force or invariants -----------------------


@query("fuzzy_search")
def _(spark, d):
    return search.fuzzy_hits(star(spark, d, ("Part", "Nation", "Region"), ("inRegion",)), "amercia", threshold=80)


@query("communities")
def _(spark, d):
    return communities.communities(star(spark, d, ("Customer", "Supplier", "Nation", "Region"), ("inNation", "inRegion")), seed=1)


@query("layout_positions")
def _(spark, d):
    found = presentation.layout(star(spark, d, ("Supplier", "Nation", "Region"), ("inNation", "inRegion")), iterations=20)
    return spark.createDataFrame([(k, *v) for k, v in sorted(found.items())], "id string, x double, y double")


@query("rdf_triples")
def _(spark, d):
    n = _table(spark, d, "nation")
    base = "http://example.org/"
    rows = n.select(F.explode(F.array(
        F.struct(F.concat(F.lit(base + "n"), F.col("n_nationkey")).alias("s"), F.lit(rdf.LABELS[0]).alias("p"), F.col("n_name").alias("o"), F.lit("literal").alias("kind")),
        F.struct(F.concat(F.lit(base + "n"), F.col("n_nationkey")).alias("s"), F.lit(base + "inRegion").alias("p"), F.concat(F.lit(base + "r"), F.col("n_regionkey")).alias("o"), F.lit("uri").alias("kind")),
    )).alias("t")).select("t.*", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"))
    return graph_rows(rdf.build(rows, {"ex": base}, include_dangling_targets=True))


def related_edges(g: PropertyGraph, relation: str, direction: str = "out") -> DataFrame:
    return annotate.related_ids(g, relation, direction).select("id", "nbr")


@query("related_any", f"WITH {STAR} SELECT src AS id, dst AS nbr FROM r WHERE type = 'suppliedBy' UNION SELECT dst, src FROM r WHERE type = 'suppliedBy'")
def _(spark, d):
    return related_edges(star(spark, d, ("Part", "Supplier"), ("suppliedBy",)), "suppliedBy", "any")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from strandweave import source_queries  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
