"""Queries over readers, writers and the text index.

Each writes files of a format from the driver's tables, reads them with the reader and
gives the graph's rows, so that SQL over the tables says what a reader must find.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave import sources
from strandweave.functions import variants as V
from strandweave.model import PropertyGraph
from strandweave.operators import analytics, presentation, semantic, transforms
from strandweave.plans.files import put_text, single_file
from strandweave.plans.workspace import Workspace
from strandweave.queries import STAR, _core_sql, _table, customer_months, document_records, graph_rows, query
from strandweave.sources import jsonld
from strandweave.sources.star import documents, star


def _folder(spark: SparkSession, name: str) -> str:
    return Workspace(spark, f"files-{name}").base


def _text(*parts) -> F.Column:
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _key(prefix: str, column: str):
    return _text(prefix, F.col(column).cast("string"))


def _ref(column):
    return F.struct(column.alias("@id"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


# -- JSON-LD ---------------------------------------------------------------------


def collection_lines(spark: SparkSession, d: str) -> DataFrame:
    """``(part, value)``: regions, nations, suppliers and neighbourhoods as one JSON-LD document, in order of the parts.

    Only the items share a part: rows that a sort leaves equal come as executors send them.
    """
    region, nation, supplier = (_table(spark, d, t) for t in ("region", "nation", "supplier"))
    json = lambda df, **fields: df.select(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}).alias("value"))
    one = lambda kind: F.array(F.lit(kind))
    items = [
        json(region, **{"@id": _key("#region%20", "r_regionkey"), "@type": F.lit("Place"), "name": F.array("r_name")}),
        json(nation, **{"@id": _key("#n", "n_nationkey"), "@type": F.array(F.lit("Place"), F.lit(" Nation ")), "name": F.col("n_name"), "containedIn": _ref(_key("#region%20", "n_regionkey")), "note": F.lit(None).cast("string")}),
        json(supplier, **{"@id": _key("#s", "s_suppkey"), "@type": F.lit(""), "name": F.col("s_name"), "balance": F.col("s_acctbal"), "location": F.array(_ref(_key("#n", "s_nationkey")), _ref(F.lit("#gone"))), "nested": F.struct(_key("#n", "s_nationkey").alias("@id"), F.lit(1).alias("more"))}),
        json(nation.where("n_nationkey > 0"), **{"@id": _key("#rel%20", "n_nationkey"), "@type": F.array(F.lit("Relationship"), F.lit("Next")), "source": _ref(_text("#n", (F.col("n_nationkey") - 1).cast("string"))), "target": _key("#n", "n_nationkey"), "since": F.lit("1900")}),
        json(nation.where("n_nationkey > 0"), **{"@id": _key("#half", "n_nationkey"), "@type": one("Relationship"), "source": _ref(_key("#n", "n_nationkey"))}),
        json(region, **{"@type": F.lit("NoId"), "name": F.col("r_name")}),
    ]
    head = ['{"@context": "https://w3id.org/ro/crate/1.1/context", "@graph": [', '{"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "about": {"@id": "./"}},', '{"@id": "./", "@type": "Dataset", "name": "Places"}']
    ends = spark.createDataFrame([*enumerate(head), (len(head) + 1, "]}")], "part int, value string")
    return ends.unionAll(_union(items).select(F.lit(len(head)), F.concat(F.lit(","), "value")))


def write_collection(spark: SparkSession, d: str, folder: str) -> None:
    single_file(collection_lines(spark, d).orderBy("part").select("value"), f"{folder}/{jsonld.DOCUMENT}")


_JSONLD = """e AS (
  SELECT '#region ' || r_regionkey AS id, 'Place' AS type FROM region UNION ALL SELECT '#n' || n_nationkey, 'Place, Nation' FROM nation UNION ALL SELECT '#s' || s_suppkey, 'Unknown' FROM supplier
), r AS (
  SELECT '#n' || n_nationkey AS src, '#region ' || n_regionkey AS dst, 'containedIn' AS type FROM nation UNION ALL SELECT '#s' || s_suppkey, '#n' || s_nationkey, 'location' FROM supplier
  UNION ALL SELECT '#s' || s_suppkey, '#n' || s_nationkey, 'nested' FROM supplier UNION ALL SELECT '#n' || (n_nationkey - 1), '#n' || n_nationkey, 'Next' FROM nation WHERE n_nationkey > 0
)
"""
_ROWS = """SELECT 'entity' AS kind, {p} || id AS a, '' AS b, type FROM e UNION ALL SELECT 'relationship', {p} || src, {p} || dst, type FROM r"""


@query("read_jsonld", f"WITH {_JSONLD} {_ROWS.format(p=repr(''))} UNION ALL VALUES ('entity', 'ro-crate-metadata.json', '', 'CreativeWork'), ('entity', './', '', 'Dataset'), ('relationship', 'ro-crate-metadata.json', './', 'about')")
def _(spark, d):
    folder = f"{_folder(spark, 'jsonld')}/places"
    write_collection(spark, d, folder)
    return graph_rows(sources.read(spark, folder))


@query("read_jsonld_properties", "SELECT '#s' || s_suppkey AS id, s_name AS name, s_acctbal AS balance, '[\"#n' || s_nationkey || '\",\"#gone\"]' AS location, 1 AS more FROM supplier UNION ALL SELECT '#region ' || r_regionkey, r_name, NULL, NULL, NULL FROM region")
def _(spark, d):
    folder = f"{_folder(spark, 'jsonld')}/places"
    write_collection(spark, d, folder)
    e, p = jsonld.read(spark, folder, inline_relations=["containedIn"]).entities, F.col("props")
    rows = e.where("startswith(id, '#s') OR startswith(id, '#region')")
    return rows.select("id", V.text_of(p["name"]).alias("name"), V.number_of(p["balance"]).alias("balance"), F.to_json(p["location"]).alias("location"), F.try_variant_get(p["nested"], "$.more", "int").alias("more"))


@query("read_collections", f"WITH {_JSONLD} {_ROWS.format(p=repr('one/'))} UNION ALL {_ROWS.format(p=repr('two/'))} UNION ALL SELECT 'entity', x || 'ro-crate-metadata.json', '', 'CreativeWork' FROM (VALUES ('one/'), ('two/')) v(x)")
def _(spark, d):
    base = _folder(spark, "collections")
    for name in ("one", "two"):
        write_collection(spark, d, f"{base}/{name}")
    return graph_rows(jsonld.read_many(spark, [f"{base}/one", f"{base}/two"]))


# -- tables, dumps, triples, documents, folders ----------------------------------

_TABLES = {
    "ENTITY": "SELECT 's' || s_suppkey AS EID, 'Corporate Body - Supplier' AS ETYPE, s_name AS NAME, s_acctbal AS BALANCE FROM supplier UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 5 > 0 THEN 'Place' END, n_name, NULL FROM nation",
    "RELATEDENTITY": "SELECT 's' || s_suppkey AS EID, 'n' || s_nationkey AS REID, CASE WHEN s_suppkey % 2 = 0 THEN 'located in' END AS RERELATIONSHIP FROM supplier UNION ALL SELECT 's' || s_suppkey, 'nowhere', 'lost' FROM supplier",
    "ENTITYNAME": "SELECT 's' || s_suppkey AS EID, 'also ' || s_name AS ALT FROM supplier UNION ALL SELECT 's' || s_suppkey, 'once ' || s_name FROM supplier WHERE s_suppkey % 3 = 0",
    "DOBJECT": "SELECT p_partkey AS DOID, p_name AS TITLE FROM part",
    "DOBJECTVERSION": "SELECT p_partkey AS DOID, 'img/' || p_partkey || '.png' AS DOV FROM part WHERE p_size > 25",
}
_TABLES_SQL = """SELECT 'entity' AS kind, 's' || s_suppkey AS a, '' AS b, 'Corporate_Body, Supplier' AS type FROM supplier
UNION ALL SELECT 'entity', 'n' || n_nationkey, '', CASE WHEN n_nationkey % 5 > 0 THEN 'Place' ELSE 'Unknown' END FROM nation
UNION ALL SELECT 'entity', CAST(p_partkey AS VARCHAR), '', 'DigitalObject' FROM part UNION ALL SELECT 'entity', 'img/' || p_partkey || '.png', '', 'File' FROM part WHERE p_size > 25
UNION ALL SELECT 'relationship', 's' || s_suppkey, 'n' || s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'located in' ELSE 'RELATEDENTITY' END FROM supplier
UNION ALL SELECT 'relationship', CAST(p_partkey AS VARCHAR), 'img/' || p_partkey || '.png', 'hasFile' FROM part WHERE p_size > 25"""
_DETAILS_SQL = "SELECT 's' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS names, 'also ' || s_name AS alt FROM supplier"


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables of a heritage export, from the driver's."""
    for t in ("supplier", "nation", "part"):
        _table(spark, d, t).createOrReplaceTempView(t)
    found = {name: spark.sql(sql) for name, sql in _TABLES.items()}
    for t in ("supplier", "nation", "part"):
        spark.catalog.dropTempView(t)
    return found


def write_tables(spark: SparkSession, d: str, folder: str) -> str:
    for name, df in _tables(spark, d).items():
        line = df.select(F.to_csv(F.struct("*"), {"escape": '"', "quoteAll": "true", "emptyValue": "", "nullValue": ""}).alias("value"))
        head = spark.createDataFrame([(",".join(df.columns),)], "value string")
        single_file(head.withColumn("o", F.lit(0)).unionAll(line.withColumn("o", F.lit(1))).orderBy("o").select("value"), f"{folder}/{'deep/' * (name == 'DOBJECT')}{name}.csv")
    return folder


def write_dump(spark: SparkSession, d: str, folder: str) -> str:
    """The same tables as a dump of two files that an entry script includes."""
    for name, df in _tables(spark, d).items():
        literal = lambda f: F.coalesce(F.col(f.name).cast("string") if f.dataType.simpleString() in ("bigint", "double") else F.concat(F.lit("E'"), F.replace(F.col(f.name), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
        rows = df.select(F.concat(F.lit(f"INSERT INTO {name.lower()} VALUES ("), F.concat_ws(", ", *[literal(f) for f in df.schema.fields]), F.lit(");")).alias("value"))
        head = spark.createDataFrame([(f"CREATE TABLE {name.lower()} ({', '.join(c.lower() + ' text' for c in df.columns)}); -- {name}",)], "value string")
        single_file(head.withColumn("o", F.lit(0)).unionAll(rows.withColumn("o", F.lit(1))).orderBy("o").select("value"), f"{folder}/tables/{name}.sql")
    put_text(spark, f"{folder}/initialise.sql", "-- entry\n" + "".join(f"\\i tables/{name}.sql\n" for name in _TABLES))
    put_text(spark, f"{folder}/unused.sql", "INSERT INTO entity VALUES ('never', 'Read', 'x', 1);\n")
    return folder


@query("read_csv_tables", _TABLES_SQL)
def _(spark, d):
    return graph_rows(sources.read(spark, write_tables(spark, d, _folder(spark, "csv"))))


def _details(g: PropertyGraph) -> DataFrame:
    p = F.col("props")
    names = F.transform(V.elements(p["entitynames"]), lambda x: F.try_variant_get(x, "$.ALT", "string"))
    return g.entities.where("startswith(id, 's')").select("id", V.text_of(p["NAME"]).alias("name"), F.size(names).alias("names"), F.array_min(names).alias("alt"))


@query("read_csv_details", _DETAILS_SQL)
def _(spark, d):
    return _details(sources.read(spark, write_tables(spark, d, _folder(spark, "csv"))))


@query("read_sql_dump", _TABLES_SQL)
def _(spark, d):
    return graph_rows(sources.read(spark, write_dump(spark, d, _folder(spark, "sql"))))


@query("read_sql_details", _DETAILS_SQL)
def _(spark, d):
    return _details(sources.read(spark, write_dump(spark, d, _folder(spark, "sql"))))


_RDF = "http://example.org/"
_RDF_SQL = f"""SELECT 'entity' AS kind, '{_RDF}n' || n_nationkey AS a, '' AS b, 'ex:Nation' AS type FROM nation UNION ALL SELECT 'entity', '{_RDF}s' || s_suppkey, '', '' FROM supplier
UNION ALL SELECT 'relationship', '{_RDF}s' || s_suppkey, '{_RDF}n' || s_nationkey, 'ex:at' FROM supplier"""


@query("read_triples", _RDF_SQL)
def _(spark, d):
    """N-Triples beside Turtle, which has the nations; what leads to a region dangles."""
    folder = _folder(spark, "rdf")
    s, n = _table(spark, d, "supplier"), _table(spark, d, "nation")
    uri = lambda prefix, c: F.concat(F.lit(f"<{_RDF}{prefix}"), F.col(c).cast("string"), F.lit(">"))
    lines = s.select(F.explode(F.array(
        F.concat(uri("s", "s_suppkey"), F.lit(f" <{_RDF}at> "), uri("n", "s_nationkey"), F.lit(" .")),
        F.concat(uri("s", "s_suppkey"), F.lit(" <http://www.w3.org/2000/01/rdf-schema#label> "), F.to_json(F.col("s_name").cast("variant")), F.lit(" .")),
    )).alias("value"))
    single_file(lines, f"{folder}/suppliers.nt")
    own = n.select(F.concat(F.lit("ex:n"), F.col("n_nationkey").cast("string"), F.lit(" a ex:Nation ; rdfs:label "), F.to_json(F.col("n_name").cast("variant")), F.lit("@en ; ex:in ex:r"), F.col("n_regionkey").cast("string"), F.lit(" .")).alias("value"))
    head = spark.createDataFrame([("@prefix ex: <http://example.org/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .",)], "value string")
    single_file(head.withColumn("o", F.lit(0)).unionAll(own.withColumn("o", F.lit(1))).orderBy("o").select("value"), f"{folder}/nations.ttl")
    return graph_rows(sources.read(spark, folder))


@query("read_rdf_xml", _RDF_SQL)
def _(spark, d):
    folder = _folder(spark, "rdfxml")
    s, n = _table(spark, d, "supplier"), _table(spark, d, "nation")
    nations = n.select(F.format_string('<ex:Nation rdf:about="n%d" rdfs:label="%s"><ex:in rdf:resource="r%d"/></ex:Nation>', "n_nationkey", "n_name", "n_regionkey").alias("value"))
    suppliers = s.select(F.format_string('<rdf:Description rdf:about="s%d"><rdfs:label xml:lang="en">%s</rdfs:label><ex:at><rdf:Description rdf:about="n%d"/></ex:at></rdf:Description>', "s_suppkey", "s_name", "s_nationkey").alias("value"))
    head = spark.createDataFrame([(f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:ex="{_RDF}" xml:base="{_RDF}">',)], "value string")
    parts = [head, nations.unionAll(suppliers), spark.createDataFrame([("</rdf:RDF>",)], "value string")]
    single_file(_union([x.withColumn("o", F.lit(i)) for i, x in enumerate(parts)]).orderBy("o").select("value"), f"{folder}/places.rdf")
    return graph_rows(sources.read(spark, folder))


_MARKDOWN_SQL = """SELECT 'entity' AS kind, 'regions/r' || r_regionkey AS a, '' AS b, 'Region' AS type FROM region UNION ALL SELECT 'entity', 'n' || n_nationkey, '', 'Nation' FROM nation
UNION ALL SELECT 'relationship', 'n' || n_nationkey, 'regions/r' || n_regionkey, 'linksTo' FROM nation UNION ALL SELECT 'relationship', 'regions/r' || n_regionkey, 'n' || n_nationkey, 'linksTo' FROM nation"""


@query("read_markdown", _MARKDOWN_SQL)
def _(spark, d):
    folder = _folder(spark, "markdown")
    nations = sorted(map(tuple, _table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()))
    put_text(spark, f"{folder}/index.md", "---\ntitle: Places\n---\n")
    for k, name, r in nations:
        put_text(spark, f"{folder}/n{k}.md", f"---\ntype: Nation\ntitle: {name}\n---\nIt lies in [its region](regions/r{r}.md), not in `[this](regions/r0.md)` or [nowhere](gone.md).\n")
    for k, name in sorted(map(tuple, _table(spark, d, "region").select("r_regionkey", "r_name").collect())):
        links = " ".join(f"[{n}][n{i}]" for i, n, r in nations if r == k)
        put_text(spark, f"{folder}/regions/r{k}.md", f"---\ntype: Region\ntitle: {name}\n---\n{links}\n\n" + "".join(f"[n{i}]: /n{i}.md\n" for i, _, r in nations if r == k))
    return graph_rows(sources.read(spark, folder))


@query("read_folder", """SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.txt' AS id, 'File' AS type, 'n' || n_nationkey || '.txt' AS name, octet_length(encode(n_name)) AS bytes, 'r' || n_regionkey || '/' AS parent FROM nation
UNION ALL SELECT DISTINCT 'r' || n_regionkey || '/', 'Dataset', 'r' || n_regionkey, NULL, './' FROM nation""")
def _(spark, d):
    folder = f"{_folder(spark, 'folder')}/top"
    for k, name, r in map(tuple, _table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()):
        put_text(spark, f"{folder}/r{r}/n{k}.txt", name)
    g, p = sources.read(spark, folder), F.col("props")
    rows = g.entities.join(g.relationships.select(F.col("dst").alias("id"), F.col("src").alias("parent")), "id")
    return rows.select("id", F.col("types")[0].alias("type"), V.text_of(p["name"]).alias("name"), F.try_variant_get(p["contentSize"], "$", "bigint").alias("bytes"), "parent")


# -- writers ---------------------------------------------------------------------


def _parts(spark: SparkSession, d: str) -> PropertyGraph:
    return star(spark, d, ("Part", "Supplier"), ("suppliedBy",))


@query("write_csv_nodes", "SELECT 'p' || p_partkey AS id, p_name AS label, 'Part' AS type, 'Part|' || p_brand AS types, replace(p_type, ' ', '|') AS words, CAST(p_size AS VARCHAR) AS size FROM part UNION ALL SELECT 's' || s_suppkey, s_name, 'Supplier', 'Supplier', NULL, NULL FROM supplier")
def _(spark, d):
    path = _parts(spark, d).write(f"{_folder(spark, 'out')}/g", format="csv")
    return spark.read.csv(f"{path}/nodes.csv", header=True, escape='"').select("id", "label", "type", "types", "words", "size")


@query("write_csv_edges", "SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, 'suppliedBy' AS type, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4")
def _(spark, d):
    path = _parts(spark, d).write(f"{_folder(spark, 'out')}/g", format="csv")
    quantity = F.col("quantity").cast("double").cast("bigint").cast("string")
    return spark.read.csv(f"{path}/edges.csv", header=True, escape='"').groupBy("source", "target", "type", quantity.alias("quantity")).agg(F.count("*").alias("n"))


@query("write_graphml", "SELECT 'n' || n_nationkey AS id, n_name AS label, 'r' || n_regionkey AS target FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, NULL FROM region")
def _(spark, d):
    path = star(spark, d, ("Nation", "Region"), ("inRegion",)).write(f"{_folder(spark, 'out')}/g.graphml")
    lines = spark.read.text(path)
    nodes = lines.where("startswith(value, '<node')").select(F.regexp_extract("value", '<node id="([^"]*)"', 1).alias("id"), F.regexp_extract("value", '<data key="n0">([^<]*)<', 1).alias("label"))
    edges = lines.where("startswith(value, '<edge')").select(F.regexp_extract("value", 'source="([^"]*)"', 1).alias("id"), F.regexp_extract("value", 'target="([^"]*)"', 1).alias("target"))
    return nodes.join(edges, "id", "left")


@query("write_text", "SELECT '=== supplier | s' || s_suppkey || ' | properties ===' AS head, 'name: ' || s_name AS line FROM supplier")
def _(spark, d):
    path = star(spark, d, ("Supplier",), ("suppliedBy",)).write(f"{_folder(spark, 'out')}/t", format="text")
    lines = F.split("value", "\n")
    return spark.read.option("lineSep", "\n\n").text(path).select(lines[0].alias("head"), F.filter(lines, lambda x: x.startswith("name:"))[0].alias("line"))


@query("write_parquet", f"WITH {STAR} SELECT type, count(*) AS n, count(DISTINCT src) AS sources FROM r GROUP BY type")
def _(spark, d):
    path = star(spark, d).write(f"{_folder(spark, 'out')}/p", format="parquet")
    return spark.read.parquet(f"{path}/relationships").groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


# -- index -----------------------------------------------------------------------


def letter_counts(texts: pd.Series) -> pd.Series:
    """An embedder that SQL has too: lengths without some letters, scaled."""
    return pd.Series([[(len(t) - t.count(c)) / 64 for c in "eatu "] for t in texts], dtype=object)


letter_counts.__annotations__ = {"texts": pd.Series, "return": pd.Series}
_RECORDS = r"""t AS (SELECT source AS source_id, 'd' || doc_id AS entity_id, text, lang, doc_id, regexp_extract_all(text, '\w+|[^\w\s]') AS w FROM documents WHERE trim(text) <> '')"""
_LETTERS = ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in "eatu ")


def _index(spark: SparkSession, d: str, **settings) -> str:
    path = f"{_folder(spark, 'index')}/index"
    semantic.index_records(document_records(spark, d), path, embed=letter_counts, **settings)
    return path


@query("index_chunks", f"WITH {_RECORDS}, c AS (SELECT source_id, entity_id, len(w) AS n, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 200 THEN 1 ELSE CAST(ceil((len(w) - 200) / 160.0) AS BIGINT) + 1 END)) AS i FROM t) SELECT source_id, entity_id, CAST(i AS INTEGER) AS chunk_index, CAST(least(i * 160 + 200, n) - i * 160 AS INTEGER) AS tokens FROM c")
def _(spark, d):
    store = semantic.Store(spark, _index(spark, d, window=200, overlap=40))
    return store.chunks().select("source_id", "entity_id", "chunk_index", "tokens")


# windows larger than any text, so that a chunk is a text
_NEAREST = f"""WITH {_RECORDS}, v AS (SELECT *, [x / 64.0 FOR x IN [{", ".join(f"length(text) - (length(text) - length(replace(text, '{c}', '')))" for c in "eatu ")}]] AS v FROM t),
q AS (SELECT v AS q FROM v ORDER BY doc_id LIMIT 1), s AS (SELECT source_id, entity_id, lang, sqrt(list_sum(list_transform(list_zip(v, q), lambda p: pow(CAST(p[1] AS FLOAT)::DOUBLE - CAST(p[2] AS DOUBLE), 2)))) AS dist FROM v, q)
"""


def _first_text(spark: SparkSession, d: str) -> str:
    return _table(spark, d, "documents").where("trim(text) <> ''").orderBy("doc_id").select("text").first()[0]


@query("index_search", _NEAREST + "SELECT entity_id, round(1 / (1 + dist), 6) AS score FROM s WHERE lang IN ('de', 'fr') ORDER BY dist, source_id, entity_id LIMIT 10")
def _(spark, d):
    g, path = documents(spark, d), _index(spark, d, window=1 << 20, overlap=0)
    hits = g.chunk_records(_first_text(spark, d), k=10, store_path=path, filters={"entity_types": ["de", "fr"]}, embed=letter_counts)
    return hits.select("entity_id", F.round("score", 6).alias("score"))


@query("semantic_search", _NEAREST + "SELECT 'entity' AS kind, entity_id AS a, '' AS b, 'File, ' || lang AS type FROM s WHERE lang = 'de' ORDER BY dist, entity_id LIMIT 6")
def _(spark, d):
    g, path = documents(spark, d), _index(spark, d, window=1 << 20, overlap=0)
    return graph_rows(g.select(entity_types="de").search(_first_text(spark, d), mode="semantic", k=6, store_path=path, embed=letter_counts))


@query("stored_text_records", f"WITH {_RECORDS} SELECT source_id, entity_id, md5(text) AS text_md5, CAST(len(w) AS INTEGER) AS token_count, lang FROM t WHERE lang = 'es'")
def _(spark, d):
    g, path = documents(spark, d), _index(spark, d)
    r = g.select(entity_types="es").text_records(store_path=path, include_properties=["lang"])
    return r.select("source_id", "entity_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "token_count", V.text_of(F.col("lang")).alias("lang"))


@query("index_update", "WITH s AS (SELECT source, max(CASE WHEN doc_id % 97 = 3 AND trim(text) <> '' THEN 1 ELSE 0 END) AS changed FROM documents WHERE trim(text) <> '' GROUP BY source) SELECT count(*) FILTER (source = 'src2') AS new, count(*) FILTER (source NOT IN ('src1', 'src2') AND changed = 1) AS changed, count(*) FILTER (source NOT IN ('src1', 'src2') AND changed = 0) AS unchanged, count(*) FILTER (source = 'src1') AS removed FROM s")
def _(spark, d):
    now, path = document_records(spark, d), f"{_folder(spark, 'index')}/index"
    key = F.substring("entity_id", 2, 20).cast("bigint")
    semantic.index_records(now.where("source_id <> 'src2'").withColumn("text", F.when(key % 97 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), path, embed=letter_counts)
    done = semantic.index_records(now.where("source_id <> 'src1'"), path, embed=letter_counts)
    return spark.createDataFrame([tuple(done[k] for k in ("new", "changed", "unchanged", "removed"))], "new bigint, changed bigint, unchanged bigint, removed bigint")


# -- whole graphs ----------------------------------------------------------------


@query("components_whole", """WITH m AS (SELECT 'c' || c_custkey AS id, c_nationkey AS n FROM customer UNION ALL SELECT 'o' || o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_nationkey FROM nation),
r AS (SELECT id, n_regionkey AS r FROM m JOIN nation ON n = n_nationkey UNION ALL SELECT 'r' || r_regionkey, r_regionkey FROM region)
SELECT id, min(id) OVER (PARTITION BY r) AS component FROM r""")
def _(spark, d):
    return analytics.components(star(spark, d, ("Customer", "Order", "Supplier", "Nation", "Region"), ("placedBy", "inNation", "inRegion")))


@query("kcore_whole", _core_sql(8).replace(" WHERE o_orderpriority = '1-URGENT'", "") + " SELECT id FROM core")
def _(spark, d):
    return transforms.peel(customer_months(spark, d, None), 8)[0]


@query("node_sizes_whole", f"WITH {STAR}, d AS (SELECT e.id, e.types[1] AS t, count(n.nbr) AS g FROM e LEFT JOIN n ON e.id = n.id GROUP BY 1, 2) SELECT id, t AS type, round(3 + 17 * sqrt(g / CAST((SELECT max(g) FROM d) AS DOUBLE)), 6) AS size FROM d")
def _(spark, d):
    return presentation.node_payload(star(spark, d)).select("id", "type", F.round("size", 6).alias("size"))
