"""Queries over whole tables against brute force on a small fixture."""

import datetime
import random
from collections import Counter, defaultdict

import pytest

from quiver import suite

WHEN = datetime.datetime(2024, 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def users():
    rng = random.Random(12)
    return [8, *(rng.randrange(120) for _ in range(699)), 8, 8, 119]


@pytest.fixture(scope="module")
def tables(spark, users, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    made = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N", 0), (1, "M", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "C", 0, 1.5, "S")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(1, "S", 1, 2.5)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(1, "P", "B", "T", 3, 4.5)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(1, 1, "O", 5.5, WHEN, "L")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(1, 1, 1, 1, 1.0, 2.0, 0.0, 0.0, "R", "O", WHEN)] * 2, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "events": ([(i, WHEN, u, "t", 1.0, "{}") for i, u in enumerate(users)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
        "documents": ([(1, "it's", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long"),
        "pages": ([(1, "u", "h")], "page_id long, url string, html string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_whole_paths(spark, tables, users):
    ask = lambda name: Counter(tuple(r) for r in suite.QUERIES[name](spark, tables).collect())
    edges = list(enumerate(zip(users, users[1:], strict=False)))
    out = defaultdict(list)
    for e, (s, d) in edges:
        out[s].append((e, d))
    walks = [((), (8,))]
    level = walks
    for _ in range(3):
        level = [((*es, e), (*ns, d)) for es, ns in level for e, d in out[ns[-1]]]
        walks = walks + level
    walks = [w for w in walks if w[0]]
    trails = [w for w in walks if len(set(w[0])) == len(w[0])]
    paths = [w for w in walks if len(set(w[1])) == len(w[1])]
    hops = lambda ws: Counter(Counter(len(es) for es, _ in ws).items())
    assert len(edges) > 600 and len(walks) > len(trails) > len(paths)
    assert ask("varlen_1_3") == Counter((ns[-1], len(es)) for es, ns in trails)
    assert ask("varlen_bounds") == Counter(Counter(ns[-1] for es, ns in trails if len(es) > 1).items())
    assert (ask("walk_mode"), ask("trail_mode"), ask("acyclic_mode")) == (hops(walks), hops(trails), hops(paths))
    ends = Counter()
    for _, (s, d) in edges:
        ends.update({s, d})
    assert ask("expand_undirected") == Counter(ends.items())
    ways, seen, now = {}, {8}, Counter({8: 1})
    for n in range(1, 5):
        after = Counter()
        for s, w in now.items():
            for _, d in out[s]:
                after[d] += w
        now = Counter({d: w for d, w in after.items() if d not in seen})
        seen |= set(now)
        ways |= {d: (n, w) for d, w in now.items()}
    assert ask("shortest_path") == Counter((d, n) for d, (n, _) in ways.items())
    assert ask("all_shortest") == Counter((d, n, w) for d, (n, w) in ways.items())


def test_whole_export_and_count(spark, tables, users):
    lines = [r.line for r in suite.QUERIES["export_lines"](spark, tables).collect()]
    edges = 2 + 1 + 1 + 1 + 2 * 2 + len(users) + len(users) - 1
    assert suite.QUERIES["call_edge_count"](spark, tables).first()[0] == edges
    kinds = Counter(line.split(":`")[1].split("`")[0] for line in lines)
    assert kinds == {"Region": 1, "Nation": 2, "Customer": 1, "Supplier": 1, "Part": 1, "Orders": 1, "Event": len(users), "Document": 1, "Page": 1, "User": len(set(users)), "IN_REGION": 2, "IN_NATION": 1, "BASED_IN": 1, "PLACED": 1, "HAS_PART": 2, "SHIPPED_BY": 2, "PERFORMED": len(users), "NEXT_USER": len(users) - 1}
    assert "INSERT (:`Document` {_id: 'document:1', `doc_id`: 1, `text`: 'it''s', `lang`: 'en', `source`: 's', `n_chars`: 4});" in lines
    following = Counter(line for line in lines if "NEXT_USER" in line)
    assert following == Counter(f"MATCH (a {{_id: 'user:{s}'}}), (b {{_id: 'user:{d}'}}) INSERT (a)-[:`NEXT_USER`]->(b);" for s, d in zip(users, users[1:], strict=False))


def test_point_gets_and_edge_scans(spark, tables):
    graph = suite.load_graph(spark, tables)
    assert [r.n_name for r in graph.get_node("nation:1").collect()] == ["M"]
    for missing in ("nation:01", "nation:x", "nation:9", "nowhere:1", ""):
        assert graph.get_node(missing).count() == 0
    assert "PushedFilters: [IsNotNull(n_nationkey), EqualTo(n_nationkey,1)]" in graph.get_node("nation:1")._jdf.queryExecution().toString()
    ids = {r.id for r in graph.scan_edges().filter("label = 'IN_REGION'").collect()}
    assert len(ids) == 2 and graph.scan_edges(1).count() == 1
    assert all(graph.get_edge(i).count() == 1 for i in ids) and graph.get_edge("in_region:none").count() == 0
