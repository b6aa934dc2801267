"""Readers, writers, text index and pages on small inputs."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from strandweave import sinks, source_queries, sources
from strandweave.functions import variants as V
from strandweave.model import PropertyGraph
from strandweave.operators import presentation, semantic, text
from strandweave.sources import jsonld, markdown, rdf, rdfxml, sqldump, tabular
from strandweave.streaming import incremental
from tests.test_graph import edge_set, graph, ids

DOCUMENT = {
    "@context": "https://w3id.org/ro/crate/1.1/context",
    "@graph": [
        {"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "about": {"@id": "./"}},
        {"@id": "./", "@type": "Dataset", "name": "Small", "hasPart": [{"@id": "a%20file.txt"}]},
        {"@id": "a%20file.txt", "@type": ["File", " Scan "], "name": ["Wrapped"], "author": {"@id": "#ann"}, "note": None, "also": [{"@id": "#ann"}, {"@id": "#gone"}], "nested": {"@id": "#x", "more": 1}},
        {"@id": "#ann", "@type": "Person", "name": "Ann", "worksFor": {"@id": "#org"}, "lists": [[1, 2], "x"]},
        {"@id": "#org", "@type": "", "name": "Org"},
        {"@id": "#rel%20one", "@type": ["Relationship", "Superior"], "source": {"@id": "#ann"}, "target": "#org", "since": "1900"},
        {"@id": "#half", "@type": ["Relationship", "Superior"], "source": {"@id": "#ann"}},
        {"@type": "NoId"},
    ],
}


@pytest.fixture
def collection(tmp_path):
    folder = tmp_path / "small"
    folder.mkdir()
    (folder / jsonld.DOCUMENT).write_text(json.dumps(DOCUMENT))
    return str(folder)


def test_jsonld(spark, collection):
    g = sources.read(spark, collection)
    assert ids(g) == {"ro-crate-metadata.json", "./", "a file.txt", "#ann", "#org"}
    assert edge_set(g) == {("ro-crate-metadata.json", "./", "about"), ("./", "a file.txt", "hasPart"), ("a file.txt", "#ann", "author"), ("a file.txt", "#ann", "also"), ("#ann", "#org", "worksFor"), ("#ann", "#org", "Superior")}
    rows = {r["id"]: r for r in g.entities.collect()}
    assert rows["a file.txt"]["types"] == ["File", "Scan"] and rows["#org"]["types"] == ["Unknown"]
    p = {k: json.loads(v.toJson()) for k, v in rows["a file.txt"]["props"].items()}
    assert p["name"] == "Wrapped" and p["author"] == "#ann" and p["also"] == ["#ann", "#gone"] and p["nested"] == {"@id": "#x", "more": 1}
    rel = g.relationships.where("rel_id IS NOT NULL").first()
    assert rel["rel_id"] == "#rel%20one" and set(rel["props"]) == {"since"}
    assert g.title == "Small" and g.metadata["_root_id"] == "./"
    small = jsonld.read(spark, collection, include_root=False, inline_relations=["worksFor"])
    assert "./" not in ids(small) and edge_set(small) == {("#ann", "#org", "worksFor"), ("#ann", "#org", "Superior")}
    with pytest.raises(TypeError):
        jsonld.read(spark, collection, inline_relations="x")


def test_several_collections(spark, collection, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / jsonld.DOCUMENT).write_text(json.dumps(DOCUMENT))
    g = jsonld.read_many(spark, [collection, str(other)])
    assert {"small/#ann", "other/#ann"} <= ids(g) and ("other/#ann", "other/#org", "worksFor") in edge_set(g)
    assert "small/./" in ids(jsonld.restore_root(g))
    with pytest.raises(ValueError, match="small"):
        jsonld.read_many(spark, [collection, collection])


def test_written_collection_in_any_order_of_equal_parts(spark):
    rows = source_queries.collection_lines(spark, "/root/testdata/sf0.001").collect()
    for found in (rows, rows[::-1]):
        items = json.loads("\n".join(r["value"] for r in sorted(found, key=lambda r: r["part"])))["@graph"]
        assert [x["@id"] for x in items[:2]] == [jsonld.DOCUMENT, "./"] and len(items) == len(rows) - 2


def test_tables(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "ENTITY.csv").write_text("EID,ETYPE,NAME\nE1,Person - Public Figure,Ann\nE2,,Bob\n,x,y\n")
    (tmp_path / "sub" / "RELATEDENTITY.csv").write_text("EID,REID,RERELATIONSHIP,NOTE\nE1,E2,knows,n\nE1,E9,knows,\nE2,E1,,\n")
    (tmp_path / "ENTITYNAME.csv").write_text("EID,ALT\nE1,Annie\nE1,Nan\n,zzz\n")
    (tmp_path / "DOBJECT.csv").write_text("DOID,TITLE\n1,Pic\n")
    (tmp_path / "DOBJECTVERSION.csv").write_text("DOID,DOV\n1,img/a.png\n")
    g = sources.read(spark, str(tmp_path))
    assert ids(g) == {"E1", "E2", "1", "img/a.png"}
    assert edge_set(g) == {("E1", "E2", "knows"), ("E2", "E1", "RELATEDENTITY"), ("1", "img/a.png", "hasFile")}
    e = {r["id"]: r for r in g.entities.collect()}
    assert e["E1"]["types"] == ["Person", "Public_Figure"] and e["E2"]["types"] == ["Unknown"]
    assert json.loads(e["E1"]["props"]["entitynames"].toJson()) == [{"ALT": "Annie"}, {"ALT": "Nan"}]
    assert spark.createDataFrame([(1.0,), (2.5,)], "x double").select(tabular.clean_id(F.col("x"))).collect()[0][0] == "1"


def test_sql_dump(spark, tmp_path):
    (tmp_path / "initialise.sql").write_text("\\i data.sql\n")
    (tmp_path / "data.sql").write_text("-- dump\nDROP TABLE entity;\nCREATE TABLE entity (eid varchar(9) PRIMARY KEY, etype text, n integer);\nINSERT INTO entity VALUES ('E1', E'Per\\'son', 3), ('E2', 'It''s; fine', -4);\nCREATE TABLE earrship (eid text, arcid text, relationship text);\nCREATE TABLE arcresource (arcid text);\nINSERT INTO arcresource (arcid) VALUES ('A1');\nINSERT INTO earrship VALUES ('E1', 'A1', 'in');\n")
    g = sources.read(spark, str(tmp_path))
    assert ids(g) == {"E1", "E2", "A1"} and edge_set(g) == {("E1", "A1", "in")}
    assert {r["id"]: r["types"] for r in g.entities.collect()}["E2"] == ["It's;_fine"]
    assert dict(list(sqldump.parse_dump("INSERT INTO t (a,b) VALUES (-1, NULL), (2.5, true)"))) == {"T": {"A": 2.5, "B": True}}
    (tmp_path / "initialise.sql").write_text("\\i ../data.sql\n")
    with pytest.raises(ValueError, match="outside"):
        sources.read(spark, str(tmp_path))


TURTLE = """@prefix ex: <http://example.org/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:a a ex:Person ; rdfs:label "Anna"@de, "Ann"@en ; ex:age 41 ; ex:ok true ; ex:size 1.5 ; ex:born "1900-01-01"^^xsd:date ; ex:knows ex:b, ex:gone .
ex:b rdfs:label \"\"\"Bob "B" \"\"\" ; ex:at [ ex:city "X" ] . # end
"""


def test_rdf(spark, tmp_path):
    (tmp_path / "x.ttl").write_text(TURTLE)
    (tmp_path / "y.nt").write_text('<http://example.org/b> <http://example.org/knows> <http://example.org/a> .\n# c\n<http://example.org/c> <http://example.org/n> "q\\"\\n" .\n')
    with pytest.warns(UserWarning, match="1 relationships"):
        g = sources.read(spark, str(tmp_path))
    base = "http://example.org/"
    e = {r["id"]: r for r in g.entities.collect()}
    assert {base + "a", base + "b", base + "c"} <= set(e)
    p = {k: json.loads(v.toJson()) for k, v in e[base + "a"]["props"].items()}
    assert p["name"] == "Ann" and p["ex:age"] == 41 and p["ex:ok"] is True and p["ex:size"] == 1.5 and p["ex:born"]["datatype"].endswith("date")
    assert e[base + "a"]["types"] == ["ex:Person"] and json.loads(e[base + "c"]["props"][base + "n"].toJson() if base + "n" in e[base + "c"]["props"] else e[base + "c"]["props"]["ex:n"].toJson()) == 'q"\n'
    assert {(base + "a", base + "b", "ex:knows"), (base + "b", base + "a", "ex:knows")} <= edge_set(g) and g.metadata["dropped_dangling_count"] == 1
    stubs = rdf.read(spark, str(tmp_path / "x.ttl"), include_dangling_targets=True)
    assert base + "gone" in ids(stubs)


RDF_XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://example.org/" xml:base="http://example.org/doc">
<ex:Person rdf:about="http://example.org/a" ex:nick="An"><ex:age rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">41</ex:age><ex:knows rdf:resource="#b"/><ex:at rdf:parseType="Resource"><ex:city xml:lang="de">Wien</ex:city></ex:at></ex:Person>
<rdf:Description rdf:ID="b"><ex:list rdf:parseType="Collection"><rdf:Description rdf:nodeID="x"/></ex:list><ex:raw rdf:parseType="Literal"><i>q</i></ex:raw></rdf:Description>
<rdf:Seq rdf:nodeID="x"><rdf:li>one</rdf:li><rdf:li rdf:resource="http://example.org/a"/></rdf:Seq>
</rdf:RDF>"""


def test_rdf_xml():
    triples, prefixes = rdfxml.parse(RDF_XML, "f")
    ex, r = "http://example.org/", rdfxml.RDF
    blank = lambda p: next(t[2] for t in triples if t[1] == p)
    city, cell = blank(ex + "at"), blank(ex + "list")
    want = {
        (ex + "a", r + "type", ex + "Person", "uri", None, None), (ex + "a", ex + "nick", "An", "literal", None, None), (ex + "a", ex + "age", "41", "literal", None, "http://www.w3.org/2001/XMLSchema#integer"),
        (ex + "a", ex + "knows", ex + "doc#b", "uri", None, None), (ex + "a", ex + "at", city, "blank", None, None), (city, ex + "city", "Wien", "literal", "de", None),
        (ex + "doc#b", ex + "list", cell, "blank", None, None), (cell, r + "first", "_:fnx", "blank", None, None), (cell, r + "rest", r + "nil", "uri", None, None), (ex + "doc#b", ex + "raw", "<i>q</i>", "literal", None, r + "XMLLiteral"),
        ("_:fnx", r + "type", r + "Seq", "uri", None, None), ("_:fnx", r + "_1", "one", "literal", None, None), ("_:fnx", r + "_2", ex + "a", "uri", None, None),
    }
    assert set(triples) == want and prefixes["ex"] == ex
    with pytest.raises(ValueError, match="RDF/XML"):
        rdfxml.parse("<a>")


def test_markdown(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "index.md").write_text("---\ntitle: Bundle\n---\nhello\n")
    (tmp_path / "one.md").write_text("---\ntype: Concept\ntitle: One\n---\nSee [two](d/two.md), [ref][r], [out](http://x/), `[no](d/two.md)`, [gone](nope.md), ![img](d/two.md).\n\n```\n[no](d/two.md)\n```\n\n[r]: /d/two\n")
    (tmp_path / "d" / "two.md").write_text("---\ntype: Concept\nwhen: 2001-02-03\n---\nBack to [one](../one.md) and [up](../../x.md)\n")
    (tmp_path / "d" / "bad.md").write_text("no front matter")
    with pytest.warns(UserWarning):
        g = sources.read(spark, str(tmp_path))
    assert ids(g) == {"one", "d/two"} and g.relationships.count() == 3
    assert g.title == "Bundle" or g.metadata["title"] == "Bundle"
    assert g.metadata["skipped_documents"] == 1 and g.metadata["broken_links"] == 2
    assert markdown.resolve("a%20b", "x/y.md") == "x/a b.md" and markdown.resolve("../../z", "x/y.md") is None and markdown.resolve("log.md", "y.md") is None


def test_folder(spark, tmp_path):
    (tmp_path / "f" / "sub").mkdir(parents=True)
    (tmp_path / "f" / "a b.txt").write_text("hello")
    (tmp_path / "f" / "sub" / "c.png").write_bytes(b"123")
    g = sources.read(spark, str(tmp_path / "f"))
    assert ids(g) == {"./", "a b.txt", "sub/", "sub/c.png"}
    assert edge_set(g) == {("./", "a b.txt", "hasPart"), ("./", "sub/", "hasPart"), ("sub/", "sub/c.png", "hasPart")}
    p = {r["id"]: {k: v.toPython() for k, v in r["props"].items()} for r in g.entities.collect()}
    assert p["a b.txt"] == {"name": "a b.txt", "contentSize": 5, "encodingFormat": "text/plain"}
    assert presentation.inspect(g, "a b.txt") == "hello" and presentation.inspect(g, "../../etc") is None
    assert "hello" in presentation.view(g, "a b.txt") and "sub/c.png" in presentation.gallery(g)
    with pytest.raises(FileNotFoundError):
        sources.read(spark, str(tmp_path / "none"))


@pytest.fixture
def small(spark):
    return graph(spark, [("a", ["Person"], {"name": "A & B", "tags": ["x|y", "z"], "o": {"k": 1}, "id": "own"}), ("b", ["Person"], {"ok": True, "n": 1.5})], [("a", "b", "knows", {"w": 2}, None), ("b", "a", "knows", {}, "#r")])


def test_writers(spark, small, tmp_path):
    small.write(str(tmp_path / "out"), format="csv")
    nodes = {r["id"]: r for r in spark.read.csv(str(tmp_path / "out" / "nodes.csv"), header=True, escape='"').collect()}
    assert nodes["a"]["tags"] == "x\\|y|z" and nodes["a"]["o"] == '{"k":1}' and nodes["a"]["prop_id"] == "own" and nodes["b"]["ok"] == "True" and nodes["b"]["n"] == "1.5"
    with pytest.raises(Exception, match="(?i)exists"):
        small.write(str(tmp_path / "out"), format="csv")
    small.write(str(tmp_path / "out"), format="csv", overwrite=True)
    small.write(str(tmp_path / "g.graphml"))
    doc = (tmp_path / "g.graphml").read_text()
    with pytest.raises(FileExistsError):
        small.write(str(tmp_path / "g.graphml"))
    root = ET.fromstring(doc.encode())
    assert len([x for x in root.iter() if x.tag.endswith("}node")]) == 2 and sorted(x.get("id") for x in root.iter() if x.tag.endswith("}edge")) == ["e0", "e1"]
    small.write(str(tmp_path / "t"), format="text")
    assert "name: A & B" in "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    with pytest.raises(sinks.UnknownFormatError):
        small.write(str(tmp_path / "x"), format="nope")


def test_text_records(small):
    r = {x["entity_id"]: x["text"] for x in small.text_records(source_kind="properties").collect()}
    assert r["a"] == "[Person]\nid: own\nname: A & B\ntags: x|y, z"
    assert small.text_records(source_kind="properties", text_properties=[]).count() == 0
    assert small.text_records(source_kind="properties", filters={"entity_types": []}).count() == 0
    with pytest.raises(ValueError):
        small.text_records(source_kind="properties", filters={"nope": "x"})
    with pytest.raises(TypeError):
        small.text_records(include_properties="name")


def test_chunks(spark):
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([("s", "  " + " ".join(words) + " "), ("t", " few words "), ("u", "!")], "id string, text string")
    rows = text.chunks(df, 20, 5).collect()
    own = sorted((r for r in rows if r["id"] == "s"), key=lambda r: r["chunk_index"])
    assert [r["chunk"].split()[0] for r in own] == [f"w{i}" for i in range(0, 195, 15)][: len(own)] and own[-1]["chunk"].split()[-1] == "w199"
    assert all(r["tokens"] == len(r["chunk"].split()) for r in own) and len(own) == 13
    assert [r["chunk"] for r in rows if r["id"] == "t"] == [" few words "]


def records(spark, rows):
    return spark.createDataFrame(rows, incremental.RECORD)


def test_index(spark, tmp_path):
    path = str(tmp_path / "index")
    first = records(spark, [("s1", "e1", "file", ["File"], "red apples and pears"), ("s2", "e2", "file", ["File"], "blue whales swim far"), ("s2", "e3", "file", ["Note"], "green grass grows")])
    assert semantic.index_records(first, path) == {"new": 2, "changed": 0, "unchanged": 0, "removed": 0}
    second = records(spark, [("s2", "e2", "file", ["File"], "blue whales swim far"), ("s2", "e3", "file", ["Note"], "green grass grows"), ("s3", "e4", "file", ["File"], "yellow sun")])
    assert semantic.index_records(second, path) == {"new": 1, "changed": 0, "unchanged": 1, "removed": 1}
    store = semantic.Store(spark, path)
    assert store.known_source_ids() == ["s2", "s3"] and store.records().count() == 3
    probe = list(semantic.hashed_words(64)(__import__("pandas").Series(["blue whales"]))[0])
    hits = store.nearest(probe, 2).collect()
    assert hits[0]["entity_id"] == "e2" and hits[0]["chunk"] == "blue whales swim far" and hits[0]["score"] == pytest.approx(1 / (1 + hits[0]["distance"]))
    assert [h["entity_id"] for h in store.nearest(probe, 5, {"entity_types": ["Note"]}).collect()] == ["e3"]
    with pytest.raises(ValueError, match="other settings"):
        semantic.index_records(second, path, window=10)
    e = spark.createDataFrame([("e2",), ("e3",)], "id string").select("id", F.lit(0).cast("bigint").alias("ord"), F.array(F.lit("File")).alias("types"), F.from_json(F.lit("{}"), "map<string,variant>").alias("props"), F.lit(None).cast("string").alias("source"))
    g = PropertyGraph(e, spark.createDataFrame([], "ord bigint, src string, dst string, type string, props map<string,variant>, rel_id string"))
    assert ids(g.search("blue whales", mode="semantic", k=1, store_path=path)) == {"e2"}


def test_stream(spark, tmp_path):
    inbox = str(tmp_path / "in")
    records(spark, [("s1", "e1", "file", ["File"], "red apples")]).write.parquet(inbox)
    stream = lambda: incremental.index_stream(spark.readStream.schema(incremental.RECORD).parquet(inbox), str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination(120)
    assert stream()
    records(spark, [("s2", "e2", "file", ["File"], "blue whales")]).write.mode("append").parquet(inbox)
    assert stream()
    assert semantic.Store(spark, str(tmp_path / "ix")).known_source_ids() == ["s1", "s2"]


def test_pages(small):
    assert presentation.colour("#AbC") == "#aabbcc" and presentation.css_size(5) == "5px"
    with pytest.raises(ValueError):
        presentation.colour("red")
    drawing = small.visualise("svg", iterations=3)
    assert drawing.startswith("<svg") and "A &amp; B" in drawing
    assert "<canvas" in small.visualise("2d", iterations=2, collapse_edges=True) and small.glimpse(iterations=2).startswith("<svg")
    xy = small.layout(iterations=5)
    assert set(xy) == {"a", "b"} and xy == small.layout(iterations=5)
    with pytest.raises(ValueError):
        small.visualise("4d")


def test_shown(spark, small):
    rows = {r["id"]: r for r in small.entities.select("id", *[V.shown(F.col("props")[k]).alias(k) for k in ("tags", "ok", "n")]).collect()}
    assert rows["a"]["tags"] == "['x|y', 'z']" and rows["b"]["ok"] == "True" and rows["b"]["n"] == "1.5"
