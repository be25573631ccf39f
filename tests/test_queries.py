"""Queries on the social graph: what each clause, function and rule gives."""

import datetime

import pytest

from quiver.errors import AnalysisError, CatalogError, ConflictError, ConstraintError, QuerySyntaxError
from quiver.lang.parser import parse
from quiver.operators import fulltext
from quiver.session import Session
from quiver.sources.graph import Graph, graph_id
from quiver.sources.text import export_graph, import_graph, import_lines


@pytest.fixture(scope="module")
def session(spark):
    people = spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 35), (3, "Carol", 28), (4, "Dave", 42), (5, "Eve", 25)], "pid int, name string, age int")
    firms = spark.createDataFrame([(1, "Acme"), (2, "Globex"), (3, "Initech")], "cid int, name string")
    knows = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "a int, b int")
    works = spark.createDataFrame([(1, 1, 2020), (2, 2, 2018), (4, 3, 2015)], "p int, c int, since int")
    graph = Graph(spark, "social", integrity=True).add_nodes("Person", people, "pid").add_nodes("Company", firms, "cid")
    graph.add_edges("KNOWS", knows, ("Person", "a"), ("Person", "b")).add_edges("WORKS_AT", works, ("Person", "p"), ("Company", "c"), properties=["since"])
    s = Session(spark)
    s.register(graph)
    return s


def rows(session, text, graph="social", **parameters):
    return [tuple(r) for r in session.query(text, graph, parameters).collect()]


GOLDEN = [
    ("MATCH (n:NonExistent) RETURN n.name", []),
    ("MATCH (n:Person) WHERE n.age > 30 RETURN n.name", [("Bob",), ("Dave",)]),
    ("MATCH (a:Company), (b:Company) RETURN COUNT(*)", [(9,)]),
    ("MATCH (n:Person), (n:Person) RETURN COUNT(*)", [(5,)]),
    ("MATCH (a:Person)-[r:KNOWS]->(b:Person) RETURN DISTINCT a.name", [("Alice",), ("Bob",)]),
    ("MATCH (a {name: 'Alice'})-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN a.name, b.name, c.name", [("Alice", "Bob", "Dave")]),
    ("MATCH (a {name: 'Alice'})-[:KNOWS]->()-[:KNOWS]->(c) RETURN c.name", [("Dave",)]),
    ("MATCH (p:Person) RETURN COUNT(p), SUM(p.age), AVG(p.age), MIN(p.age), MAX(p.age), COUNT(*) + 1", [(5, 160, 32.0, 25, 42, 6)]),
    ("MATCH (a:Person)-[:KNOWS]->(b) RETURN a.name, COUNT(b) AS c", [("Alice", 2), ("Bob", 1)]),
    ("MATCH (b {name: 'Bob'})<-[:KNOWS]-(s) RETURN s.name", [("Alice",)]),
    ("MATCH (p:Person) WHERE p.age > 30 WITH p MATCH (p)-[:WORKS_AT]->(c) RETURN p.name", [("Bob",), ("Dave",)]),
    ("MATCH (a:Person)-[w:WORKS_AT {since: 2018}]->(:Company {name: 'Globex'}) RETURN a.name", [("Bob",)]),
    ("MATCH (a:Person)-[:KNOWS|WORKS_AT]->(x) RETURN COUNT(*)", [(6,)]),
    ("MATCH (a:Person)-[r]-(b) WHERE a.name = 'Bob' RETURN type(r), COUNT(*)", [("KNOWS", 2), ("WORKS_AT", 1)]),
    ("MATCH (p:Person) OPTIONAL MATCH (p)-[:WORKS_AT]->(c) WHERE c.name = 'Acme' RETURN COUNT(*), COUNT(c)", [(5, 1)]),
    ("MATCH (p:Person) WHERE NOT EXISTS { (p)-[:KNOWS]->() } RETURN p.name", [("Carol",), ("Dave",), ("Eve",)]),
    ("MATCH (p:Person) WHERE EXISTS { (p)-[:KNOWS]->() } OR p.age = 25 RETURN p.name", [("Alice",), ("Bob",), ("Eve",)]),
    ("MATCH (p:Person) WHERE p.name LIKE '%o%' RETURN p.name", [("Bob",), ("Carol",)]),
    ("MATCH (n) WHERE n.age = NULL RETURN COUNT(*)", [(3,)]),
    ("MATCH (n) WHERE n.age <> 30 RETURN COUNT(*)", [(7,)]),
    ("MATCH (n) WHERE n.age IN [30, NULL] RETURN COUNT(*)", [(4,)]),
    ("MATCH (c:Company) RETURN c.age, c.pid IS NULL", [(None, True)] * 3),
    ("MATCH p = (a {name: 'Alice'})-[:KNOWS]->{1,3}(b) RETURN b.name, length(p), size(nodes(p))", [("Bob", 1, 2), ("Carol", 1, 2), ("Dave", 2, 3)]),
    ("MATCH (a {name: 'Alice'})-[e:KNOWS]->{0,}(b) RETURN b.name, size(e)", [("Alice", 0), ("Bob", 1), ("Carol", 1), ("Dave", 2)]),
    ("MATCH ANY SHORTEST (a {name: 'Alice'})-[e:KNOWS]-{1,4}(b {name: 'Dave'}) RETURN size(e)", [(2,)]),
    ("MATCH (p:Person) RETURN p.name ORDER BY p.age DESC LIMIT 2 OFFSET 1", [("Bob",), ("Alice",)]),
    ("MATCH (a:Person)-[:KNOWS]->(b) RETURN a.name AS n, COUNT(*) AS c ORDER BY c DESC LIMIT 1", [("Alice", 2)]),
    ("MATCH (p:Person) WITH p.age / 10 AS d, COUNT(*) AS c WHERE c > 1 RETURN d, c", [(2, 2), (3, 2)]),
    ("MATCH (p:Person) RETURN p.age / 10 AS d, COUNT(*) AS c GROUP BY p.age / 10 HAVING COUNT(*) = 1", [(4, 1)]),
    ("MATCH (p:Person) RETURN p.name AS x UNION MATCH (c:Company) RETURN c.name AS x EXCEPT MATCH (p:Person) RETURN p.name", [("Acme",), ("Globex",), ("Initech",)]),
    ("MATCH (n:Person) RETURN n.age INTERSECT RETURN 30 AS age", [(30,)]),
    ("RETURN 7 / 2, -7 / 2, -7 % 3, 7 / 2.0, 1 + 2 * 3, 1 = 1.0, 1 + NULL, 'a' || 'b'", [(3, -3, -1, 3.5, 7, True, None, "ab")]),
    ("RETURN TRUE AND NULL, FALSE AND NULL, TRUE OR NULL, TRUE XOR FALSE, NOT NULL", [(None, False, True, True, None)]),
    ("RETURN NULL = NULL, NULL <> 1, NULL < 1, 2 IN [1, NULL], NULL IN [NULL]", [(True, True, None, False, True)]),
    ("RETURN CASE WHEN NULL THEN 1 ELSE 2 END, CASE NULL WHEN NULL THEN 1 END, CASE 3 WHEN 4 THEN 1 END", [(2, 1, None)]),
    ("RETURN toString('a'), toString(NULL), toString(3.0), toInteger('42'), toInteger(-2.9), toFloat(2), size('héé'), size([1, 2]), toString(TRUE)", [("a", None, "3", 42, -2, 2.0, 3, 2, "true")]),
    ("RETURN date('2024-02-29'), time('10:20'), datetime('2024-02-29 10:20:30'), toString(duration('P1Y2M3DT2H30M'))", [(datetime.date(2024, 2, 29), "10:20:00", datetime.datetime(2024, 2, 29, 10, 20, 30), "P1Y2M3DT2H30M")]),
    ("RETURN duration('P1Y2M3D') AS d, type(1), type('x'), keys({b: 1, a: 2})", [((14, 3, 0), "INTEGER", "STRING", ["a", "b"])]),
    ("LET x = [1, 2, 3] FOR y IN x FILTER y > 1 RETURN y * 2", [(4,), (6,)]),
    ("MATCH (a:Person) WHERE a.age > $n RETURN a.name LIMIT $k", [("Dave",)]),
    ("MATCH (p:Person) WHERE p.age = VALUE { MATCH (q:Person) RETURN MAX(q.age) } RETURN p.name", [("Dave",)]),
    ("CALL db.nodeCount()", [(8,)]), ("CALL db.edgeCount()", [(6,)]), ("CALL db.labels()", [("Company",), ("Person",)]),
    ("CALL db.schema() YIELD labels", [(["Company", "Person"],)]), ("CALL db.labels() YIELD nothing", [(None,), (None,)]),
    ("MATCH (p:Person) WHERE p.age < 0 RETURN COUNT(*), SUM(p.age), COLLECT(p.name), AVG(p.age)", [(0, 0, [], None)]),
    ("MATCH (n) RETURN size(COLLECT(n.age)), COUNT(DISTINCT n.age), SUM(DISTINCT n.age)", [(8, 5, 160)]),
]


@pytest.mark.parametrize("text, want", GOLDEN)
def test_golden(session, text, want):
    got = rows(session, text, n=40, k=3)
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_whole_entities_and_names(session):
    found = session.query("MATCH (p:Person {name: 'Eve'}) RETURN p, p.age, 1 + 1, id(p), labels(p)", "social")
    assert found.columns == ["p", "p.age", "col_2", "col_3", "col_4"]
    row = found.first()
    assert row[0].id == "person:5" and row[0].properties.name == "Eve" and tuple(row[3:]) == ("person:5", ["Person"])
    edge = session.query("MATCH (:Person {name: 'Dave'})-[w:WORKS_AT]->() RETURN w", "social").first()[0]
    assert (edge.label, edge.source_id, edge.target_id, edge.properties.since) == ("WORKS_AT", "person:4", "company:3", 2015)


@pytest.mark.parametrize("text", ["MATCH (a RETURN a", "RETURN 1 < 2 < 3", "RETURN 'open", "MATCH (a)-[:X]->{3,1}(b) RETURN a", "MATCH (a) DELETE a.x", "RETURN " + "(" * 300 + "1" + ")" * 300, "SELECT 1"])
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


@pytest.mark.parametrize("text", ["MATCH (a:Person) RETURN b", "RETURN nothing(1)", "MATCH (a:Person) RETURN a.age + a.name", "MATCH (a:Person) RETURN COUNT(*) LIMIT 'x'", "RETURN 1 IN 2", "CALL db.nothing()", "RETURN $missing", "MATCH (a:Person) WHERE COUNT(*) > 1 RETURN a.age", "MATCH (a:Person) RETURN a.name UNION RETURN 1, 2"])
def test_analysis_errors(session, text):
    with pytest.raises(AnalysisError):
        session.query(text, "social")


def test_plans(session):
    """Only used columns are read, a node of which nothing is used costs no join."""
    plan = lambda text: session.query(text, "social")._jdf.queryExecution().optimizedPlan().toString()
    assert plan("MATCH (a:Person)-[:KNOWS]->(b:Person) RETURN b.name").count("Join") == 2
    assert plan("MATCH (a:Person)-[:KNOWS]->(:Person) RETURN a.name").count("Join") == 1


def test_writes(spark):
    s = Session(spark)
    assert rows(s, "INSERT (:P {n: 1, s: 'it''s'})-[:K {w: 2}]->(:Q {n: 2})", "g") == [(3,)]
    rows(s, "INSERT (:P {n: 5})", "g")
    rows(s, "MATCH (a:P), (b:Q) WHERE a.n = 5 INSERT (a)-[:K {w: a.n}]->(b)", "g")
    assert (s.stats.nodes_created, s.stats.edges_created) == (0, 1)
    assert sorted(rows(s, "MATCH (a:P)-[k:K]->(b) RETURN a.n, k.w, b.n", "g")) == [(1, 2, 2), (5, 5, 2)]
    assert sorted(rows(s, "MATCH (a:P) SET a.n = a.n + 10, a.z = 'new' RETURN a.n, a.z", "g")) == [(11, "new"), (15, "new")]
    rows(s, "MATCH (a:P {n: 11}) SET a:R", "g")
    assert rows(s, "MATCH (a:R) RETURN labels(a), a.s", "g") == [(["P", "R"], "it's")]
    rows(s, "MATCH (a:R) REMOVE a.z, a:R", "g")
    assert sorted(rows(s, "MATCH (a:P) RETURN a.n, a.z", "g")) == [(11, None), (15, "new")]
    rows(s, "MATCH (a:P {n: 11}) DELETE a", "g")
    assert (s.stats.nodes_deleted, s.stats.edges_deleted) == (1, 1)
    rows(s, "CREATE UNIQUE INDEX u FOR (x:P) ON (x.n)", "g")
    with pytest.raises(ConstraintError):
        s.query("INSERT (:P {n: 15})", "g")
    assert rows(s, "MATCH (a) RETURN COUNT(*)", "g") == [(2,)]


def test_transactions_and_store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    s = Session(spark, root)
    s.query("CREATE GRAPH g")
    s.query("INSERT (:P {n: 1})", "g")
    with s.transaction("g"):
        s.query("INSERT (:P {n: 2})", "g")
        assert rows(s, "MATCH (a:P) RETURN COUNT(*)", "g") == [(2,)]
    with pytest.raises(ZeroDivisionError), s.transaction("g"):
        s.query("MATCH (a:P) DELETE a", "g")
        raise ZeroDivisionError
    assert rows(Session(spark, root), "MATCH (a:P) RETURN COUNT(*)", "g") == [(2,)]
    old = s.at("g", 1)
    assert old.node_ids().count() == 1
    other = Session(spark, root)
    s.query("INSERT (:P {n: 3})", "g")
    other.query("INSERT (:P {n: 4})", "g")  # on top of what the first session has written
    assert rows(other, "MATCH (a:P) RETURN COUNT(*)", "g") == [(4,)]
    s.begin("g")
    s.query("MATCH (a:P {n: 1}) SET a.n = 10", "g")
    other.query("MATCH (a:P {n: 1}) SET a.n = 11", "g")
    with pytest.raises(ConflictError):
        s.commit("g")
    s.begin("g")
    s.query("MATCH (a:P {n: 2}) SET a.n = 20", "g")
    other.query("MATCH (a:P {n: 3}) SET a.n = 30", "g")
    s.commit("g")
    assert sorted(rows(s, "MATCH (a:P) RETURN a.n", "g")) == [(4,), (11,), (20,), (30,)]
    title = s.store.backup("g", "day")
    assert s.store.backups() == [title] and s.store.restore(title).node_ids().count() == 4
    with pytest.raises(CatalogError):
        s.query("CREATE GRAPH g")
    s.query("DROP GRAPH g")
    assert rows(s, "LIST GRAPHS") == [] and rows(s, "DROP GRAPH IF EXISTS g") == [("Graph 'g' does not exist",)]
    assert graph_id("g") == graph_id("g")


def test_declarations_outlive_the_session(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    s = Session(spark, root)
    s.query("CREATE GRAPH g")
    s.query("INSERT (:P {n: 1}), (:P {n: 2})", "g")
    s.query("CREATE UNIQUE INDEX u FOR (x:P) ON (x.n)", "g")
    again = Session(spark, root)
    assert list(again.graph("g").indexes) == ["u"]
    with pytest.raises(ConstraintError):
        again.query("INSERT (:P {n: 2})", "g")
    again.query("DROP INDEX u", "g")
    s.query("INSERT (:P {n: 2})", "g")
    assert Session(spark, root).graph("g").indexes == {} and rows(s, "MATCH (a:P) RETURN COUNT(*)", "g") == [(3,)]


def test_export_and_import_lose_nothing(spark, tmp_path):
    texts = ["one\ntwo", "a\r\nb", "it's \\n no break", "\\", "'", "{x: 'y', z}", "INSERT (a)-[:`K`]->(b);", "\u2028 ü", ""]
    when = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    graph = Graph(spark, "g").add_nodes("T", spark.createDataFrame([(i, t, when) for i, t in enumerate(texts)], "k long, t string, w timestamp_ntz"), "k")
    graph.add_edges("K", spark.createDataFrame([(0, 1), (0, 1), (1, 2)], "a long, b long"), ("T", "a"), ("T", "b"))
    assert export_graph(graph, f"file://{tmp_path}/out") == len(texts) + 3
    s = Session(spark)
    assert import_graph(s, f"file://{tmp_path}/out", "back") == len(texts) + 3
    assert sorted(rows(s, "MATCH (a:T) RETURN a.k, a.t, a.w", "back")) == [(i, t, when) for i, t in enumerate(texts)]
    assert rows(s, "MATCH p = TRAIL (a:T {k: 0})-[:K]->{1,2}(b) RETURN length(p) AS n, COUNT(*) AS c ORDER BY n", "back") == [(1, 2), (2, 2)]
    assert import_lines(s, ["INSERT (:T {w: DATETIME('2024-01-02T03:04:05.678901')})", "-- no statement"], "again") == 1
    assert rows(s, "MATCH (a:T) RETURN a.w", "again") == [(when,)]


def test_export_and_import(spark, session, tmp_path):
    count = export_graph(session.graph("social"), f"file://{tmp_path}/out")
    assert count == 14
    other = Session(spark)
    import_graph(other, f"file://{tmp_path}/out", "back")
    assert sorted(rows(other, "MATCH (a:Person)-[w:WORKS_AT]->(c) RETURN a.name, w.since, c.name", "back")) == sorted(rows(session, "MATCH (a:Person)-[w:WORKS_AT]->(c) RETURN a.name, w.since, c.name"))


def test_full_text(spark):
    texts = spark.createDataFrame([(1, "The quick brown fox"), (2, "Graph databases and Rust"), (3, None)], "id long, text string")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(fulltext.search(texts, "id", "text", "FOX, quick")) == [1] and ids(fulltext.search(texts, "id", "text", "a !")) == []
    assert ids(fulltext.search_prefix(texts, "id", "text", "data")) == [2]
    assert ids(fulltext.search_inverted(fulltext.inverted(texts, "id", "text"), "id", "rust and")) == [2]


def test_streams(session):
    assert [len(c) for c in session.stream("MATCH (n) RETURN n.name", "social", chunk=3)] == [3, 3, 2]
