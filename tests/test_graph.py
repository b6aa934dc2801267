"""Operators on small graphs."""

import json

import pytest
from pyspark.sql import functions as F

from strandweave.functions import similarity, temporal
from strandweave.functions import variants as V
from strandweave.model import PropertyGraph
from strandweave.operators import analytics, communities
from strandweave.operators.components import connected_components
from strandweave.plans import cypher
from strandweave.plans.numbering import numbered

E = "id string, ord long, types array<string>, j string, source string"
R = "ord long, src string, dst string, type string, j string, rel_id string"


def graph(spark, entities, edges):
    """entities: (id, types, properties); edges: (src, dst, type, properties, rel_id)."""
    e = spark.createDataFrame([(i, k, list(t), json.dumps(p), "s") for k, (i, t, p) in enumerate(entities)], E)
    r = spark.createDataFrame([(k, a, b, t, json.dumps(p), x) for k, (a, b, t, p, x) in enumerate(edges)], R)
    made = lambda df: df.withColumn("props", F.from_json("j", "map<string,variant>")).drop("j")
    return PropertyGraph(made(e).select("id", "ord", "types", "props", "source"), made(r).select("ord", "src", "dst", "type", "props", "rel_id"))


def ids(g):
    return {r["id"] for r in g.entities.select("id").collect()}


def edge_set(g):
    return {(r["src"], r["dst"], r["type"]) for r in g.relationships.collect()}


@pytest.fixture(scope="module")
def people(spark):
    return graph(
        spark,
        [("a", ["Person", "Author"], {"name": "Ann Peters", "age": 30, "tags": ["x", "y", None]}), ("b", ["Person"], {"name": "Bob", "age": "41", "birthDate": "c.1966"}), ("p", ["Paper"], {"title": "Graphs", "year": 1999, "tags": "x"}), ("o", ["Org"], {}), ("z", ["Person"], {"name": None})],
        [("a", "p", "author", {}, None), ("b", "p", "reviewer", {"weight": 3}, "#r1"), ("a", "b", "knows", {}, None), ("b", "a", "knows", {}, None), ("a", "o", "memberOf", {}, None), ("a", "a", "cites", {}, None)],
    )


def test_select(people):
    assert ids(people.select(entity_types="Person")) == {"a", "b", "z"}
    assert edge_set(people.select(relationship_types="author")) == {("a", "p", "author"), ("a", "a", "cites")}
    assert ids(people.select(min_connections=2)) == {"a", "b", "p"}
    assert ids(people.select(max_connections=0)) == {"z"}
    assert ids(people.select(id="nobody")) == set()
    assert ids(people.select(time_range=(1960, 1970))) == {"b"}
    with pytest.raises(ValueError, match="Person"):
        people.select(entity_types="Persom")


def test_exclude_drop_subtract(people):
    assert ids(people.exclude(entity_types="Org")) == {"a", "b", "p", "z"}
    assert ids(people.exclude(relationship_types="memberOf")) == {"a", "b", "p", "z"}
    assert ids(people.exclude(relationship_types="memberOf", drop_isolated=False)) == {"a", "b", "p", "o", "z"}
    assert ids(people.drop("x")) == {"b", "o", "z"}
    assert ids(people.drop(["Bob"], property="name")) == {"a", "p", "o", "z"}
    with pytest.raises(TypeError):
        people.drop(30)
    assert ids(people.subtract(people.select(entity_types="Person"))) == {"p", "o"}


def test_where(people):
    assert ids(people.where(age=30)) == {"a"}
    assert ids(people.where(age="30")) == set()
    assert ids(people.where(age=(30, 41))) == {"a", "b"}
    assert ids(people.where(tags="x")) == {"a", "p"}
    assert ids(people.where(tags=["x", "y", None])) == {"a"}
    assert ids(people.where(name=None)) == set()
    assert ids(people.where()) == {"a", "b", "p", "o", "z"}


def test_expand_and_pattern(people):
    one = people.select(id="o")
    assert ids(one.expand()) == {"o", "a"}
    assert ids(one.expand(2)) == {"o", "a", "b", "p"}
    assert ids(one.expand(2, entity_types=["Person"])) == {"o", "a", "b"}
    assert ids(one.expand(3, via="memberOf")) == {"o", "a"}
    assert ids(one.expand(1, via="unknown")) == {"o"}
    assert ids(people.pattern("Person", "author", "Paper")) == {"a", "p"}
    assert edge_set(people.pattern(via="knows")) == {("a", "b", "knows"), ("b", "a", "knows"), ("a", "a", "cites")}


def test_paths_of_variable_length(spark):
    g = graph(spark, [(x, ["N"], {}) for x in "abcd"], [("a", "b", "to", {}, None), ("b", "c", "to", {}, None), ("c", "a", "to", {}, None), ("c", "d", "to", {}, None)])
    ends = lambda pattern: {r["`y.id`"] if "`y.id`" in r else r["y.id"] for r in cypher.matched_rows(g.induce(g.entities), f"MATCH (x)-[:to{pattern}]->(y) WHERE ID(x) = 'a' RETURN y")[0].collect()}
    assert ends("*1..1") == {"b"} and ends("*2") == {"c"} and ends("*0..2") == {"a", "b", "c"}
    # each edge once, so that the circle is not walked again
    assert ends("*..9") == {"a", "b", "c", "d"} and ends("*4..9") == set()
    assert {r["y.id"] for r in cypher.matched_rows(g, "MATCH (x)-[:to*2]-(y) WHERE ID(x) = 'd' RETURN y")[0].collect()} == {"a", "b"}


def test_cypher(people):
    assert ids(people.query("(a:Person)-[:author]->(b)")) == {"a", "p"}
    assert ids(people.query("(b)<-[:author|reviewer]-(a)")) == {"a", "b", "p"}
    assert ids(people.query("MATCH (a)-[r]->(b) WHERE a.name = 'Bob' RETURN b")) == {"p", "a"}
    assert ids(people.query("MATCH (a:Person)-[:knows]-(b)-[:memberOf]->(c) RETURN a, c")) == {"b", "o"}
    assert ids(people.query("MATCH (a:Person {age: 30}) RETURN ID(a)")) == {"a"}
    assert ids(people.query("MATCH (a) WHERE NOT a.name IS NULL AND (a.name CONTAINS 'nn' OR a.age > 40) RETURN a")) == {"a", "b"}
    assert ids(people.query("(a:Ghost)-[:author]->(b)")) == set()
    assert ids(people.query("MATCH (a:Person) RETURN a ORDER BY a.age DESC LIMIT 1")) != ids(people.query("MATCH (a:Person) RETURN a ORDER BY a.age LIMIT 1"))
    assert ids(people.query("MATCH (a:Person) RETURN a ORDER BY a.age SKIP 5")) == set()
    for bad in ("MATCH (a)", "MATCH (a)-[:x*]->(b) RETURN a", "MATCH (a)-[:x*3..1]->(b) RETURN a", "MATCH (a)-[:x*2..]->(b) RETURN a", "MATCH (a) RETURN a ORDER BY c.age", "MATCH (a RETURN a", "MATCH (a) RETURN b", "MATCH (a) RETURN a.name"):
        with pytest.raises(cypher.CypherError):
            people.query(bad)


def test_counts_and_records(people):
    assert [(r["types"], r["count"]) for r in people.entity_counts("types").collect()][0] == ("Person", 3)
    tags = [(V_text(r[0]), r["count"]) for r in people.entity_counts("tags").collect()]
    assert tags == [("x", 2), ("y", 1)]
    rows = {r["id"]: r for r in people.entity_records(["id", "label", "type", "missing"]).collect()}
    assert rows["a"]["label"] == "Ann Peters" and rows["p"]["label"] == "Graphs" and rows["z"]["label"] == "z" and rows["o"]["missing"] is None
    assert people.entity_records().columns[:4] == ["id", "label", "type", "types"]


def V_text(v):
    return v.toPython() if hasattr(v, "toPython") else v


def test_analytics(people):
    p = people.profile().first()
    assert (p["entities"], p["relationships"], p["components"], p["isolates"], p["self_loops"], p["multiplicity_max"]) == (5, 6, 2, 1, 1, 2)
    assert people.most_connected(1).first()["id"] == "a"
    cov = people.coverage(inline_relations=True, min_occurrences=1).collect()
    assert {(r["relationship_type"], r["side"], r["reached"], r["total"]) for r in cov if r["relationship_type"] == "reviewer"} == {("reviewer", "source", 1, 3), ("reviewer", "target", 1, 1)}
    assert people.coverage(min_occurrences=1).count() == 2
    assert people.summary()["entities"] == 5


def test_merge_and_collapse(people):
    merged = people.merge_nodes("type")
    assert ids(merged) == {"Person, Author", "Person", "Paper", "Org"}
    assert ("Person, Author", "Person", "knows") in edge_set(merged)
    c = people.collapse_edges().relationships.where("src = 'a' AND dst = 'b'").first()
    assert c["type"] == "knows" and json.loads(c["props"]["types"].toJson()) == ["knows"]
    assert people.collapse_edges().relationships.count() == 5


def test_simplify(spark):
    g = graph(spark, [(x, ["N"], {}) for x in "abcdef"], [(a, b, "e", {}, None) for a, b in ("ab", "bc", "ca", "cd", "de")])
    core = g.simplify()
    assert ids(core) == {"a", "b", "c"} and core.simplification_k == 2
    lost = core.entities.where("id = 'c'").first()["props"]["simplified"]
    assert json.loads(lost.toJson()) == {"N": 1}
    with pytest.warns(UserWarning):
        assert core.simplify() is core
    assert ids(core.expand()) == {"a", "b", "c", "d"}


def test_annotate(people):
    made = people.annotate_entities(friends=lambda e: e.related("knows").join("name"), n=lambda e: e.related("knows", "any").count(), paper=lambda e: e.has("author"), older=lambda e: e.number("age") + 1, python=lambda e: len(e.get("name") or "") + 1)
    p = {r["id"]: r["props"] for r in made.entities.collect()}
    get = lambda i, k: p[i][k].toPython()
    assert get("a", "friends") == "Bob" and get("b", "n") == 1 and get("a", "paper") is True and get("b", "older") == 42
    assert get("b", "python") == 4
    assert "friends" not in p["p"] and made.derived_fields["n"] == "annotate_entities" and made.origin is None


@pytest.mark.parametrize(
    "text, year, precision, start, end, flags",
    [
        ("1994-07-15T00:00:00.000Z", 1994, "day", "1994-07-15", "1994-07-15", ""), ("2017-03-12 00:00:00", 2017, "day", "2017-03-12", "2017-03-12", ""), ("12 March 2017", 2017, "day", "2017-03-12", "2017-03-12", ""),
        (" 1 July 1935", 1935, "day", "1935-07-01", "1935-07-01", ""), ("1 Sept 1990", 1990, "day", "1990-09-01", "1990-09-01", ""), ("Dec 1914", 1914, "month", "1914-12-01", "1914-12-31", ""), ("2017-03", 2017, "month", "2017-03-01", "2017-03-31", ""),
        ("1607", 1607, "year", "1607-01-01", "1607-12-31", ""), ("1870-71", 1870, "year", "1870-01-01", "1871-12-31", "r"), ("1945-1947", 1945, "year", "1945-01-01", "1947-12-31", "r"), ("1945-12", 1945, "month", "1945-12-01", "1945-12-31", ""),
        ("1905-12", 1905, "year", "1905-01-01", "1912-12-31", "r"), ("1995?", 1995, "year", "1995-01-01", "1995-12-31", "u"), ("1995? Onwards", 1995, "year", "1995-01-01", "1995-12-31", "u"), ("192?", 1920, "decade", "1920-01-01", "1929-12-31", "u"),
        ("1920s", 1920, "decade", "1920-01-01", "1929-12-31", ""), ("c.1966", 1966, "year", "1966-01-01", "1966-12-31", "c"), ("circa 1966", 1966, "year", "1966-01-01", "1966-12-31", "c"), ("ca. 1966", 1966, "year", "1966-01-01", "1966-12-31", "c"),
    ],
)
def test_dates(text, year, precision, start, end, flags):
    t = temporal.parse_text(text)
    assert (t.year, t.precision, str(t.start), str(t.end)) == (year, precision, start, end)
    assert (t.circa, t.uncertain, t.is_range) == ("c" in flags, "u" in flags, "r" in flags)


@pytest.mark.parametrize("text", ["19?", "1?", "see notes", "President", "", "   ", None, 5, "0000"])
def test_no_dates(text):
    assert temporal.parse_text(text) is None


def test_readings():
    r = temporal.reading({"startDate": "1900", "endDate": "1905?", "startDateModifier": "c"})
    assert (str(r["start_date"]), str(r["end_date"]), r["circa"], r["uncertain"]) == ("1900-01-01", "1905-12-31", True, True)
    assert temporal.reading({"startDate": "1914", "startDateModifier": "s"})["precision"] == "decade"
    assert temporal.reading({"recordAppendDate": "1999"}) is None
    assert temporal.reading({"dateCreated": "1999"}, start="dateCreated")["year"] == 1999
    assert temporal.falls_in({"startDate": "1900", "endDate": "1950"}, 1920, 1930)


def test_similarity():
    assert round(similarity.ratio("peters", "peter"), 1) == 90.9
    assert round(similarity.score("Peters", "Peter"), 1) == 90.9
    assert round(similarity.partial_ratio("sandy mccutchin", "sandy mccutcheon"), 1) == 92.9
    assert similarity.score("Peters", "Pam Peters") == 100
    assert similarity.lcs_length("abcbdab", "bdcaba") == 4


def test_fuzzy_search(people):
    assert ids(people.search("peters")) == {"a"}
    with pytest.raises(ValueError):
        people.search("x", mode="keyword")


def test_pipe_lists(spark):
    row = spark.range(1).select(V.pipe_list(F.array(F.lit("a|b"), F.lit("c\\d"), F.lit("")))).first()[0]
    assert row == "a\\|b|c\\\\d|" and V.decode_pipe_list(row) == ["a|b", "c\\d", ""] and V.decode_pipe_list("") == []


def test_components_and_numbers(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 1)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    rows = numbered(spark.range(50).withColumnRenamed("id", "x"), F.desc("x")).collect()
    assert all(r["number"] == 49 - r["x"] for r in rows)


def test_communities(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    g = graph(spark, [(x, ["N"], {}) for x in "abcdefz"], [(a, b, "e", {}, None) for a, b in pairs])
    found = {r["id"]: r["community"] for r in communities.communities(g, seed=1).collect()}
    assert set(found) == set("abcdefz")
    assert communities.modularity(g.neighbours(), communities.communities(g, seed=1)) > 0.2
    assert found == {r["id"]: r["community"] for r in communities.communities(g, seed=1).collect()}


def test_corpus(spark):
    stats = analytics.corpus_statistics(spark.createDataFrame([(1, 2.0), (3, 4.0)], "entities long, density double")).collect()
    assert {(r["measure"], r["min"], r["max"]) for r in stats} == {("entities", 1.0, 3.0), ("density", 2.0, 4.0)}
