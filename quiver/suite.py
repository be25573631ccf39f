"""Queries over the driver tables seen as a graph, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiver.errors import CatalogError, ConflictError, ConstraintError
from quiver.operators import fulltext
from quiver.plans.compiler import Compiler
from quiver.lang.parser import parse
from quiver.session import Session
from quiver.sources.graph import Graph, Index
from quiver.sources.shared import cut_lineage, shared_folder
from quiver.streaming.ingest import attach, ingest_edges
from quiver.sources.text import export_graph, export_statements, import_graph

#: Node label: table and key.
_NODES = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Orders": ("orders", "o_orderkey"), "Event": ("events", "event_id"), "Document": ("documents", "doc_id"), "Page": ("pages", "page_id")}
_LINES = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _following(events: DataFrame) -> DataFrame:
    """Each event but the last with the user of the next one. Ranges of ids are looked through apart, so that no task holds all events; the last event of a range takes the first user of the next range."""
    ranged = cut_lineage(events.select("event_id", "user_id").repartitionByRange("event_id").withColumn("range", F.spark_partition_id()))
    user = F.struct("user_id")
    firsts = ranged.groupBy("range").agg(F.min_by(user, "event_id").alias("first"))
    after = firsts.select("range", F.lead("first").over(Window.orderBy("range")).alias("after"))  # one row a range
    within = ranged.withColumn("within", F.lead(user).over(Window.partitionBy("range").orderBy("event_id")))
    return within.join(F.broadcast(after), "range").select("event_id", "user_id", F.coalesce("within", "after")["user_id"].alias("next_id")).filter("next_id IS NOT NULL")


def load_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The tables as a graph; all foreign keys hold. A table is opened when a query first needs it; of NEXT_USER, events are then read once."""
    read = lambda name: lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    graph = Graph(spark, "tables", integrity=True)
    for label, (table, key) in _NODES.items():
        graph.add_nodes(label, read(table), key)
    graph.add_nodes("User", lambda: read("events")().select("user_id").distinct(), "user_id")
    graph.add_edges("IN_REGION", read("nation"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"))
    graph.add_edges("IN_NATION", read("customer"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"))
    graph.add_edges("BASED_IN", read("supplier"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"))
    graph.add_edges("PLACED", read("orders"), ("Customer", "o_custkey"), ("Orders", "o_orderkey"))

    def numbered() -> DataFrame:
        # (order, line number) repeats, so lines of an order are told apart by their number in the order of all columns
        lines = read("lineitem")()
        return lines.withColumn("l_id", F.concat_ws("/", "l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*lines.columns))))

    graph.add_edges("HAS_PART", numbered, ("Orders", "l_orderkey"), ("Part", "l_partkey"), "l_id", _LINES)
    graph.add_edges("SHIPPED_BY", numbered, ("Orders", "l_orderkey"), ("Supplier", "l_suppkey"), "l_id", _LINES)
    graph.add_edges("PERFORMED", read("events"), ("User", "user_id"), ("Event", "event_id"), "event_id")
    graph.add_edges("NEXT_USER", lambda: _following(read("events")()), ("User", "user_id"), ("User", "next_id"), "event_id")
    return graph


def _gql(text: str, parameters: dict[str, Any] | None = None, prepare: Callable[[Graph], None] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = load_graph(spark, sf_dir)
        if prepare:
            prepare(graph)
        return Compiler(graph, parameters).query(parse(text).statements[0])

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, text: str, sql: str | None, parameters: dict[str, Any] | None = None, prepare: Callable[[Graph], None] | None = None) -> None:
    QUERIES[name] = _gql(text, parameters, prepare)
    if sql:
        ORACLES[name] = sql


_NEXT = "WITH RECURSIVE nx AS (SELECT event_id AS eid, user_id AS s, lead(user_id) OVER (ORDER BY event_id) AS d FROM events), e AS (SELECT * FROM nx WHERE d IS NOT NULL)"

_add("scan_label", "MATCH (n:Nation) RETURN n.n_name AS name", "SELECT n_name AS name FROM nation")
_add(
    "scan_all_count", "MATCH (n) RETURN COUNT(*) AS c",
    "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) + (SELECT count(DISTINCT user_id) FROM events) AS c",
)
_add("first_rows", "MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN c.c_name AS name, c.c_acctbal AS bal ORDER BY bal DESC, name LIMIT 10", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal > 5000 ORDER BY bal DESC, name LIMIT 10")
_add("filter_cmp", "MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN c.c_custkey AS k, c.c_acctbal AS bal", "SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_acctbal > 5000")
_add(
    "filter_and_or_not_xor", "MATCH (o:Orders) WHERE (o.o_totalprice > 1000 AND NOT o.o_orderstatus = 'F') OR (o.o_orderpriority = '1-URGENT' XOR o.o_orderstatus = 'O') RETURN o.o_orderkey AS k",
    "SELECT o_orderkey AS k FROM orders WHERE (o_totalprice > 1000 AND NOT o_orderstatus = 'F') OR ((o_orderpriority = '1-URGENT') <> (o_orderstatus = 'O'))",
)
_add("filter_null_safe", "MATCH (n) WHERE n.n_name <> 'NATION_3' AND n.r_name <> 'ASIA' AND n.c_custkey IS NULL AND n.s_suppkey IS NULL AND n.p_partkey IS NULL AND n.o_orderkey IS NULL AND n.event_id IS NULL AND n.doc_id IS NULL AND n.page_id IS NULL AND n.user_id IS NULL RETURN n.n_name AS nation, n.r_name AS region", "SELECT n_name AS nation, NULL AS region FROM nation WHERE n_name <> 'NATION_3' UNION ALL SELECT NULL, r_name FROM region WHERE r_name <> 'ASIA'")
_add("filter_in_list", "MATCH (n:Nation) WHERE n.n_name IN ['NATION_7', 'NATION_8', 'NOWHERE'] RETURN n.n_name AS name, n.n_regionkey AS region", "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_name IN ('NATION_7', 'NATION_8', 'NOWHERE')")
_add("filter_is_null", "MATCH (n) WHERE n.n_name IS NOT NULL OR n.r_name IS NOT NULL RETURN n.n_name IS NULL AS is_region, COUNT(*) AS c", "SELECT false AS is_region, count(*) AS c FROM nation UNION ALL SELECT true, count(*) FROM region")
_add("filter_like", "MATCH (p:Part) WHERE p.p_type LIKE '%O%' RETURN p.p_partkey AS k, p.p_type AS t", "SELECT p_partkey AS k, p_type AS t FROM part WHERE p_type LIKE '%O%'")
_add("param_filter", "MATCH (c:Customer) WHERE c.c_acctbal >= $least AND c.c_mktsegment IN $segments RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')", {"least": 1000, "segments": ["BUILDING", "MACHINERY"]})
_add("inline_props", "MATCH (o:Orders {o_orderstatus: 'F'}) RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'")
_add(
    "project_arith", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size + 2 * 3 AS a, p.p_size / 4 AS d, p.p_size % 7 AS m, -p.p_size AS n, p.p_size / 4.0 AS f, 1 - p.p_size AS s",
    "SELECT p_partkey AS k, CAST(p_size + 6 AS BIGINT) AS a, CAST(p_size // 4 AS BIGINT) AS d, CAST(p_size % 7 AS BIGINT) AS m, CAST(-p_size AS BIGINT) AS n, p_size / 4.0::DOUBLE AS f, CAST(1 - p_size AS BIGINT) AS s FROM part",
)
_add("project_concat", "MATCH (n:Nation) RETURN n.n_name || ' in ' || toString(n.n_regionkey) AS text", "SELECT n_name || ' in ' || CAST(n_regionkey AS VARCHAR) AS text FROM nation")
_add("project_case_searched", "MATCH (c:Customer) RETURN c.c_custkey AS k, CASE WHEN c.c_acctbal < 0 THEN 'debt' WHEN c.c_acctbal < 5000 THEN 'some' ELSE 'much' END AS class", "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS class FROM customer")
_add("project_case_simple", "MATCH (o:Orders) RETURN o.o_orderkey AS k, CASE o.o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN CAST(1 AS BIGINT) WHEN 'F' THEN 2 END AS code FROM orders")
_add(
    "fn_conversions", "MATCH (n:Nation) RETURN toString(n.n_nationkey) AS s, toInteger('42') + n.n_nationkey AS i, toFloat(n.n_nationkey) AS f, toInteger(-2.9) AS t, toString(3.0) AS u, CAST(n.n_nationkey AS STRING) AS c",
    "SELECT CAST(n_nationkey AS VARCHAR) AS s, CAST(42 + n_nationkey AS BIGINT) AS i, CAST(n_nationkey AS DOUBLE) AS f, CAST(-2 AS BIGINT) AS t, '3' AS u, CAST(n_nationkey AS VARCHAR) AS c FROM nation",
)
_add(
    "fn_size_keys_labels_type_id", "MATCH (n:Nation)-[r:IN_REGION]->(g:Region) RETURN id(n) AS id, size(n.n_name) AS size, size(keys(n)) AS keys, size(labels(n)) AS labels, type(r) AS type, id(g) AS region",
    "SELECT 'nation:' || n_nationkey AS id, CAST(length(n_name) AS BIGINT) AS size, CAST(3 AS BIGINT) AS keys, CAST(1 AS BIGINT) AS labels, 'IN_REGION' AS type, 'region:' || n_regionkey AS region FROM nation",
)
_add("fn_temporal", "MATCH (n:Nation) RETURN n.n_name AS name, toString(date('2024-02-29')) AS d, toString(datetime('2024-02-29T12:30')) AS t, toString(duration('P1Y2M3DT4H')) AS u, time('12:30') AS h", "SELECT n_name AS name, '2024-02-29' AS d, '2024-02-29T12:30:00' AS t, 'P1Y2M3DT4H' AS u, '12:30:00' AS h FROM nation")
_add("expand_out", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS nation, r.r_name AS region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("expand_in", "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) RETURN n.n_name AS nation, c.c_name AS customer", "SELECT n_name AS nation, c_name AS customer FROM nation JOIN customer ON n_nationkey = c_nationkey")
_add("expand_undirected", "MATCH (a:User)-[:NEXT_USER]-(b:User) RETURN a.user_id AS a, COUNT(*) AS c", _NEXT + " SELECT a, count(*) AS c FROM (SELECT s AS a FROM e UNION ALL SELECT d FROM e WHERE s <> d) GROUP BY a")
_add("expand_any_edge", "MATCH (n:Nation)-[r]-(x) RETURN type(r) AS t, COUNT(*) AS c", "SELECT 'IN_REGION' AS t, count(*) AS c FROM nation UNION ALL SELECT 'IN_NATION', count(*) FROM customer UNION ALL SELECT 'BASED_IN', count(*) FROM supplier")
_add("hop2", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_name = 'EUROPE' RETURN c.c_custkey AS k, n.n_name AS nation", "SELECT c_custkey AS k, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
_add(
    "hop3_region_revenue", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Orders) WITH r.r_name AS region, COUNT(*) AS orders, SUM(o.o_totalprice) AS revenue RETURN region, orders, toInteger(revenue) AS revenue ORDER BY region",
    "SELECT r_name AS region, count(*) AS orders, CAST(trunc(sum(o_totalprice)) AS BIGINT) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name",
)
_add("edge_props", "MATCH (o:Orders)-[l:HAS_PART]->(p:Part) WHERE l.l_quantity > 45 RETURN o.o_orderkey AS k, p.p_brand AS brand, l.l_quantity AS q", "SELECT l_orderkey AS k, p_brand AS brand, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45")
_add("edge_inline", "MATCH (o:Orders)-[l:HAS_PART {l_returnflag: 'R'} ]->() RETURN o.o_orderkey AS k, COUNT(*) AS c", "SELECT l_orderkey AS k, count(*) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
_add("anon_middle", "MATCH (c:Customer)-[:IN_NATION]->()-[:IN_REGION]->(r:Region) RETURN c.c_custkey AS k, r.r_name AS region", "SELECT c_custkey AS k, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_add("target_inline", "MATCH (c:Customer)-[:IN_NATION]->(:Nation {n_name: 'NATION_7'}) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'")
_add("comma_shared_var", "MATCH (c:Customer)-[:PLACED]->(o:Orders), (c)-[:IN_NATION]->(n:Nation) RETURN n.n_name AS nation, COUNT(*) AS orders", "SELECT n_name AS nation, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_add("cross_join", "MATCH (a:Region), (b:Region) RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b")
_add("theta_join", "MATCH (a:Region), (b:Region) WHERE a.r_regionkey < b.r_regionkey RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
_add("multi_match", "MATCH (n:Nation {n_name: 'NATION_7'}) MATCH (n)<-[:IN_NATION]-(c:Customer) MATCH (c)-[:PLACED]->(o:Orders) RETURN c.c_custkey AS k, o.o_orderkey AS o", "SELECT c_custkey AS k, o_orderkey AS o FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_name = 'NATION_7'")
_add("optional_match", "MATCH (o:Orders) OPTIONAL MATCH (o)-[l:HAS_PART]->(p:Part) WHERE l.l_quantity > 40 RETURN o.o_orderkey AS k, p.p_partkey AS part", "SELECT o_orderkey AS k, l_partkey AS part FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40")
_add("exists_semi", "MATCH (o:Orders) WHERE EXISTS { (o)-[l:HAS_PART]->() WHERE l.l_quantity > 49 } RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
_add("not_exists_anti", "MATCH (o:Orders) WHERE NOT EXISTS { MATCH (o)-[:HAS_PART]->(p) } RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_add("exists_flag", "MATCH (o:Orders) RETURN EXISTS { (o)-[:HAS_PART]->() } AS has, COUNT(*) AS c", "SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has, count(*) AS c FROM orders GROUP BY 1")
_add("value_subquery", "MATCH (p:Part) WHERE p.p_size = VALUE { MATCH (q:Part) RETURN MAX(q.p_size) AS m } RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
_add(
    "agg_global", "MATCH (p:Part) RETURN COUNT(*) AS n, COUNT(p.p_size) AS m, SUM(p.p_size) AS s, AVG(p.p_size) AS a, MIN(p.p_retailprice) AS lo, MAX(p.p_retailprice) AS hi, COUNT(*) + 1 AS more",
    "SELECT count(*) AS n, count(p_size) AS m, CAST(sum(p_size) AS BIGINT) AS s, avg(p_size) AS a, min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(*) + 1 AS more FROM part",
)
_add("agg_group", "MATCH (p:Part) RETURN p.p_brand AS brand, COUNT(*) AS n, SUM(p.p_size) AS s, AVG(p.p_size) AS a", "SELECT p_brand AS brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, avg(p_size) AS a FROM part GROUP BY 1")
_add("agg_distinct", "MATCH (p:Part) RETURN COUNT(DISTINCT p.p_brand) AS b, SUM(DISTINCT p.p_size) AS s", "SELECT count(DISTINCT p_brand) AS b, CAST(sum(DISTINCT p_size) AS BIGINT) AS s FROM part")
_add("agg_collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, size(COLLECT(n.n_name)) AS n, size(COLLECT(n.missing)) AS nulls", "SELECT r_name AS region, count(*) AS n, count(*) AS nulls FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_add("agg_empty", "MATCH (p:Part) WHERE p.p_size < 0 RETURN COUNT(*) AS n, SUM(p.p_size) AS s, AVG(p.p_size) AS a, MAX(p.p_name) AS m", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS VARCHAR) AS m")
_add("agg_min_max_types", "MATCH (o:Orders) RETURN o.o_orderstatus AS s, toString(MIN(o.o_orderdate)) AS lo, MAX(o.o_orderpriority) AS hi", "SELECT o_orderstatus AS s, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS lo, max(o_orderpriority) AS hi FROM orders GROUP BY 1")
_add("group_by_having", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.n_name AS nation, COUNT(*) AS c GROUP BY n.n_name HAVING COUNT(*) > 4", "SELECT n_name AS nation, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 4")
_add("with_having", "MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c.c_custkey AS k, COUNT(*) AS c WHERE c > 12 RETURN k, c", "SELECT o_custkey AS k, count(*) AS c FROM orders GROUP BY 1 HAVING count(*) > 12")
_add(
    "with_order_limit", "MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 5 MATCH (c)-[:PLACED]->(o:Orders) RETURN c.c_custkey AS k, o.o_orderkey AS o",
    "SELECT c_custkey AS k, o_orderkey AS o FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) JOIN orders ON o_custkey = c_custkey",
)
_add("order_by_agg_topk", "MATCH (o:Orders)-[:HAS_PART]->(p:Part) RETURN p.p_partkey AS k, COUNT(*) AS c ORDER BY c DESC, k LIMIT 10", "SELECT l_partkey AS k, count(*) AS c FROM lineitem GROUP BY 1 ORDER BY c DESC, k LIMIT 10")
_add("distinct_rows", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN DISTINCT n.n_name AS nation, c.c_mktsegment AS segment", "SELECT DISTINCT n_name AS nation, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey")
_add("offset_limit", "MATCH (p:Part) RETURN p.p_partkey AS k ORDER BY k LIMIT 7 OFFSET 11", "SELECT p_partkey AS k FROM part ORDER BY k LIMIT 7 OFFSET 11")
_add("union_all", "MATCH (n:Nation) RETURN n.n_regionkey AS k UNION ALL MATCH (r:Region) RETURN r.r_regionkey AS k", "SELECT CAST(n_regionkey AS BIGINT) AS k FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT) FROM region")
_add("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
_add("intersect", "MATCH (c:Customer) RETURN c.c_nationkey AS k INTERSECT MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer INTERSECT SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
_add("except_", "MATCH (n:Nation) RETURN n.n_nationkey AS k EXCEPT MATCH (s:Supplier) WHERE s.s_acctbal > 5000 RETURN s.s_nationkey AS k", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation EXCEPT SELECT CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_acctbal > 5000")
_add("except_all", "MATCH (c:Customer) RETURN c.c_nationkey AS k EXCEPT ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer EXCEPT ALL SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
_WALKS = _NEXT + ", p AS (SELECT s AS o, d AS t, [eid] AS es, [d] AS ns FROM e WHERE s = 8 UNION ALL SELECT p.o, e.d, list_append(p.es, e.eid), list_append(p.ns, e.d) FROM p JOIN e ON p.t = e.s WHERE len(p.es) < 3 AND {keep})"
_add("varlen_1_3", "MATCH (a:User {user_id: 8})-[e:NEXT_USER]->{1,3}(b:User) RETURN b.user_id AS b, size(e) AS hops", _WALKS.format(keep="NOT list_contains(p.es, e.eid)") + " SELECT t AS b, CAST(len(es) AS BIGINT) AS hops FROM p")
_add("varlen_bounds", "MATCH (a:User {user_id: 8})-[e:NEXT_USER*2..3]->(b:User) RETURN b.user_id AS b, COUNT(*) AS c", _WALKS.format(keep="NOT list_contains(p.es, e.eid)") + " SELECT t AS b, count(*) AS c FROM p WHERE len(es) >= 2 GROUP BY 1")
_add("walk_mode", "MATCH p = WALK (a:User {user_id: 8})-[:NEXT_USER]->{1,3}(b:User) RETURN length(p) AS hops, COUNT(*) AS c", _WALKS.format(keep="true") + " SELECT CAST(len(es) AS BIGINT) AS hops, count(*) AS c FROM p GROUP BY 1")
_add("trail_mode", "MATCH p = TRAIL (a:User {user_id: 8})-[:NEXT_USER]->{1,3}(b:User) RETURN length(p) AS hops, COUNT(*) AS c", _WALKS.format(keep="NOT list_contains(p.es, e.eid)") + " SELECT CAST(len(es) AS BIGINT) AS hops, count(*) AS c FROM p GROUP BY 1")
_add("acyclic_mode", "MATCH p = ACYCLIC (a:User {user_id: 8})-[:NEXT_USER]->{1,3}(b:User) RETURN length(p) AS hops, COUNT(*) AS c", _WALKS.format(keep="p.t <> p.o AND e.d <> p.o AND NOT list_contains(p.ns, e.d)") + " SELECT CAST(len(es) AS BIGINT) AS hops, count(*) AS c FROM p WHERE t <> o GROUP BY 1")
_DISTANCES = _NEXT + ", q AS (SELECT s, d, count(*) AS ways FROM e GROUP BY ALL), p AS (SELECT CAST(8 AS BIGINT) AS t, 0 AS n, CAST(1 AS HUGEINT) AS ways UNION ALL SELECT * FROM (SELECT q.d, p.n + 1, sum(p.ways * q.ways) FROM p JOIN q ON p.t = q.s WHERE p.n < 4 GROUP BY q.d, p.n + 1)), best AS (SELECT t, min(n) AS n FROM p GROUP BY t)"
_add("shortest_path", "MATCH ANY SHORTEST (a:User {user_id: 8})-[e:NEXT_USER]->{1,4}(b:User) RETURN b.user_id AS b, size(e) AS hops", _DISTANCES + " SELECT t AS b, CAST(n AS BIGINT) AS hops FROM best WHERE n > 0")
_add("all_shortest", "MATCH ALL SHORTEST (a:User {user_id: 8})-[e:NEXT_USER]->{1,4}(b:User) RETURN b.user_id AS b, size(e) AS hops, COUNT(*) AS ways", _DISTANCES + " SELECT p.t AS b, CAST(p.n AS BIGINT) AS hops, CAST(p.ways AS BIGINT) AS ways FROM p JOIN best USING (t, n) WHERE p.n > 0")
_add("let_for_filter", "MATCH (r:Region) LET x = r.r_regionkey * 10 FOR y IN [1, 2, 3] FILTER y <> 2 RETURN r.r_name AS name, x + y AS z", "SELECT r_name AS name, CAST(r_regionkey * 10 + y AS BIGINT) AS z FROM region, (VALUES (1), (3)) t(y)")
_add("call_labels", "CALL db.labels() YIELD label", "SELECT unnest(['Customer', 'Document', 'Event', 'Nation', 'Orders', 'Page', 'Part', 'Region', 'Supplier', 'User']) AS label")
_add("call_rel_types", "CALL db.relationshipTypes()", "SELECT unnest(['BASED_IN', 'HAS_PART', 'IN_NATION', 'IN_REGION', 'NEXT_USER', 'PERFORMED', 'PLACED', 'SHIPPED_BY']) AS relationshipType")
_add(
    "call_prop_keys", "CALL db.propertyKeys()",
    "SELECT DISTINCT column_name AS propertyKey FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'events', 'documents', 'pages') OR (table_name = 'lineitem' AND column_name NOT IN ('l_orderkey', 'l_partkey', 'l_suppkey'))",
)
_add("call_node_count", "CALL db.nodeCount()", ORACLES["scan_all_count"].replace(" AS c", " AS count"))
_add("call_edge_count", "CALL db.edgeCount()", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM events) + (SELECT greatest(count(*) - 1, 0) FROM events) AS count")
_add("index_equiv", "MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' AND c.c_acctbal > 5000 RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000", prepare=lambda g: g.indexes.update(seg=Index("seg", "Customer", ("c_mktsegment",))))
_add("reverse_equiv", "MATCH (o:Orders)<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n:Nation {n_name: 'NATION_9'}) RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_name = 'NATION_9'")
_add("return_star", "MATCH (n:Nation) LET name = n.n_name WITH name RETURN *", "SELECT n_name AS name FROM nation")
_add("stddev_percentile", "MATCH (p:Part) RETURN p.p_brand AS brand, toInteger(STDDEV(p.p_size) * 1000) AS sd, PERCENTILE(p.p_size, 0.5) AS median", "SELECT p_brand AS brand, CAST(trunc(stddev_samp(p_size) * 1000) AS BIGINT) AS sd, quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS median FROM part GROUP BY 1")

_add("chained_cmp", "MATCH (p:Part) WHERE 10 < p.p_size AND ((p.p_size < 20)) RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size > 10 AND p_size < 20")
_add("intersect_all", "MATCH (c:Customer) RETURN c.c_nationkey AS k INTERSECT ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer INTERSECT ALL SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
_add("literals", "RETURN 1 AS i, 2.5 AS f, 'it''s' AS s, TRUE AS b, NULL IS NULL AS n, size([1, 2, 3]) AS l", "SELECT CAST(1 AS BIGINT) AS i, CAST(2.5 AS DOUBLE) AS f, 'it''s' AS s, true AS b, true AS n, CAST(3 AS BIGINT) AS l")
_add("list_concat", "MATCH (r:Region) RETURN size([r.r_regionkey] || [1, 2]) AS n, r.r_name AS name", "SELECT CAST(3 AS BIGINT) AS n, r_name AS name FROM region")
_add("comments_and_names", "MATCH (`the region`:Region) /* all of them */ RETURN `the region`.r_name AS name -- by name", "SELECT r_name AS name FROM region")
_add("grouped_empty", "MATCH (p:Part) WHERE p.p_size < 0 RETURN p.p_brand AS brand, COUNT(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_size < 0 GROUP BY 1")
_add("simple_mode", "MATCH p = SIMPLE (a:User {user_id: 8})-[:NEXT_USER]->{1,2}(b:User) RETURN length(p) AS hops, COUNT(*) AS c", _WALKS.format(keep="NOT list_contains(p.es, e.eid) AND p.t <> p.o AND NOT list_contains(p.ns, e.d)") + " SELECT CAST(len(es) AS BIGINT) AS hops, count(*) AS c FROM p WHERE len(es) <= 2 GROUP BY 1")
_add("call_schema", "CALL db.schema() YIELD labels RETURN size(labels) AS n", "SELECT CAST(10 AS BIGINT) AS n")


def fulltext_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.search(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "License, under")


def fulltext_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.search_prefix(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "Licen")


def fulltext_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.search_inverted(fulltext.inverted(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), "doc_id", "License, under")


def index_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = load_graph(spark, sf_dir)
    graph.indexes["price"] = Index("price", "Part", ("p_retailprice",))
    return graph.range_scan("price", 920.0, 960.0).select(F.col("p_partkey").alias("k"))


def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_graph(spark, sf_dir).get_node("nation:0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))


def insert_set_delete_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph is made, changed by every kind of write, and read."""
    session = Session(spark)
    for text in (
        "INSERT (:City {name: 'A', n: 1})-[:ROAD {km: 5}]->(:City {name: 'B', n: 2})",
        "INSERT (:City {name: 'C', n: 3})",
        "MATCH (a:City {name: 'B'}), (b:City {name: 'C'}) INSERT (a)-[:ROAD {km: a.n + b.n}]->(b)",
        "MATCH (c:City) WHERE c.n > 1 SET c.n = c.n * 10, c.big = TRUE",
        "MATCH (c:City {name: 'A'}) DETACH DELETE c",
    ):
        session.query(text, "work")
    return session.query("MATCH (a:City)-[r:ROAD]->(b:City) RETURN a.name AS a, a.n AS n, r.km AS km, b.name AS b, b.big AS big", "work")


def export_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and what joins them as statements, with SQL."""
    graph = load_graph(spark, sf_dir)
    small = Graph(spark, "small", {k: graph.nodes[k] for k in ("Region", "Nation")}, {"IN_REGION": graph.edges["IN_REGION"]}, True)
    return export_statements(small).select("line")


def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node and edge of the graph; no SQL counterpart, as the text of numbers and times is the language's own."""
    return export_statements(load_graph(spark, sf_dir)).select("line")


def documents_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as statements and read back."""
    path = f"{shared_folder(spark)}/quiver-export-{uuid.uuid4().hex}"
    export_graph(Graph(spark, "texts").add_nodes("Document", spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"), path)
    session = Session(spark)
    import_graph(session, path, "texts")
    return session.query("MATCH (d:Document) RETURN d.doc_id AS doc_id, d.text AS text, d.lang AS lang, d.source AS source", "texts")


def _stored(spark: SparkSession) -> tuple[Session, str]:
    root = f"{shared_folder(spark)}/quiver-store-{uuid.uuid4().hex}"
    return Session(spark, root), root


def _outcome(session: Session, text: str, graph: str = "work") -> str:
    try:
        session.query(text, graph)
    except (ConstraintError, ConflictError, CatalogError) as problem:
        return type(problem).__name__
    return "done"


def unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unique index holds in the session that made it and in later ones, until it is dropped there."""
    first, root = _stored(spark)
    first.query("INSERT (:City {n: 1}), (:City {n: 2})", "work")
    first.query("CREATE UNIQUE INDEX one FOR (c:City) ON (c.n)", "work")
    later = Session(spark, root)
    steps = [("first", _outcome(first, "INSERT (:City {n: 2})")), ("later", _outcome(later, "INSERT (:City {n: 1})")), ("twice", _outcome(later, "CREATE UNIQUE INDEX one FOR (c:City) ON (c.n)"))]
    later.query("DROP INDEX one", "work")
    return spark.createDataFrame([*steps, ("dropped", _outcome(first, "INSERT (:City {n: 2})"))], "step string, outcome string")


def graph_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs are made, listed and dropped."""
    session, _ = _stored(spark)
    steps = [_outcome(session, x) for x in ("CREATE GRAPH a", "CREATE GRAPH a", "CREATE GRAPH IF NOT EXISTS a", "CREATE GRAPH b", "DROP GRAPH a", "DROP GRAPH a", "DROP GRAPH IF EXISTS a")]
    names = [r["name"] for r in session.query("LIST GRAPHS").collect()]
    return spark.createDataFrame([(i, x) for i, x in enumerate([*steps, *names])], "step long, outcome string")


def labels_and_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET and REMOVE of labels and properties on the regions."""
    session = Session(spark)
    session.register(Graph(spark, "work").add_nodes("Region", spark.read.parquet(f"{sf_dir}/region.parquet"), "r_regionkey"))
    for text in ("MATCH (r:Region) WHERE r.r_regionkey < 3 SET r:Low, r.half = r.r_regionkey / 2", "MATCH (r:Low {r_regionkey: 1}) REMOVE r:Low, r.half", "MATCH (r:Region {r_regionkey: 4}) DELETE r"):
        session.query(text, "work")
    return session.query("MATCH (r:Region) RETURN r.r_regionkey AS k, size(labels(r)) AS labels, r.half AS half", "work")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions on one store: a conflict, a rollback, a merge of separate changes, and a snapshot from before."""
    first, root = _stored(spark)
    first.query("INSERT (:City {n: 1}), (:City {n: 2}), (:City {n: 3})", "work")
    second = Session(spark, root)
    first.begin("work")
    first.query("MATCH (c:City {n: 1}) SET c.n = 10", "work")
    second.query("MATCH (c:City {n: 1}) SET c.n = 11", "work")
    outcomes = []
    try:
        first.commit("work")
    except ConflictError:
        outcomes.append(("conflict", 0))
    first.begin("work")
    first.query("MATCH (c:City) DELETE c", "work")
    first.rollback("work")
    first.begin("work")
    first.query("MATCH (c:City {n: 2}) SET c.n = 20", "work")
    second.query("MATCH (c:City {n: 3}) SET c.n = 30", "work")
    first.commit("work")
    cities = "MATCH (c:City) RETURN c.n AS n"
    outcomes += [("now", r["n"]) for r in first.query(cities, "work").collect()]
    old = Session(spark)
    old.register(first.at("work", 1))
    outcomes += [("before", r["n"]) for r in old.query(cities, "work").collect()]
    return spark.createDataFrame(outcomes, "state string, n long")


def backup_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup outlives later writes and a vacuum."""
    session, _ = _stored(spark)
    session.register(Graph(spark, "work").add_nodes("Nation", spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey"))
    session.query("MATCH (n:Nation {n_nationkey: 0}) SET n.n_name = 'first'", "work")
    title = session.store.backup("work")
    session.query("MATCH (n:Nation) DELETE n", "work")
    session.store.vacuum("work")
    restored = Session(spark)
    restored.register(session.store.restore(title))
    return restored.query("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name", "work")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive as a stream of edges from users to what they did, and are queried as a graph."""
    path = f"{shared_folder(spark)}/quiver-stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "user_id", "event_type", "value")
    ingest_edges(stream, f"{path}/edges", f"{path}/checkpoint", "user_id", "event_type", "event_id").awaitTermination()
    graph = Graph(spark, "stream", integrity=True)
    graph.add_nodes("User", events.select("user_id").distinct(), "user_id").add_nodes("Kind", events.select("event_type").distinct(), "event_type")
    attach(graph, "DID", f"{path}/edges", "User", "Kind")
    return Compiler(graph).query(parse("MATCH (u:User)-[d:DID]->(k:Kind) RETURN u.user_id AS user_id, k.event_type AS kind, COUNT(*) AS n").statements[0])


for _name, _query in (("stream_ingest", stream_ingest), ("documents_roundtrip", documents_roundtrip), ("unique_index", unique_index), ("graph_ddl", graph_ddl), ("labels_and_removal", labels_and_removal), ("transactions", transactions), ("backup_and_restore", backup_and_restore), ("fulltext_and", fulltext_and), ("fulltext_prefix", fulltext_prefix), ("fulltext_inverted", fulltext_inverted), ("index_range_scan", index_range_scan), ("point_get", point_get), ("insert_set_delete_roundtrip", insert_set_delete_roundtrip), ("export_lines", export_lines), ("export_places", export_places)):
    QUERIES[_name] = _query

_TOKENS = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')"
ORACLES["fulltext_and"] = ORACLES["fulltext_inverted"] = f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS}, 'license') AND list_contains({_TOKENS}, 'under')"
ORACLES["fulltext_prefix"] = f"SELECT doc_id FROM documents WHERE len(list_filter({_TOKENS}, lambda t: starts_with(t, 'licen'))) > 0"
ORACLES["index_range_scan"] = "SELECT p_partkey AS k FROM part WHERE p_retailprice >= 920 AND p_retailprice < 960"
ORACLES["point_get"] = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation WHERE n_nationkey = 0"
ORACLES["insert_set_delete_roundtrip"] = "SELECT 'B' AS a, CAST(20 AS BIGINT) AS n, CAST(5 AS BIGINT) AS km, 'C' AS b, true AS big"
ORACLES["stream_ingest"] = "SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY ALL"
ORACLES["documents_roundtrip"] = "SELECT doc_id, text, lang, source FROM documents"
ORACLES["unique_index"] = "SELECT * FROM (VALUES ('first', 'ConstraintError'), ('later', 'ConstraintError'), ('twice', 'CatalogError'), ('dropped', 'done')) t(step, outcome)"
ORACLES["graph_ddl"] = "SELECT CAST(step AS BIGINT) AS step, outcome FROM (VALUES (0, 'done'), (1, 'CatalogError'), (2, 'done'), (3, 'done'), (4, 'done'), (5, 'CatalogError'), (6, 'done'), (7, 'b')) t(step, outcome)"
ORACLES["labels_and_removal"] = "SELECT CAST(r_regionkey AS BIGINT) AS k, CAST(CASE WHEN r_regionkey IN (0, 2) THEN 2 ELSE 1 END AS BIGINT) AS labels, CAST(CASE WHEN r_regionkey IN (0, 2) THEN r_regionkey // 2 END AS BIGINT) AS half FROM region WHERE r_regionkey <> 4"
ORACLES["transactions"] = "SELECT state, CAST(n AS BIGINT) AS n FROM (VALUES ('conflict', 0), ('now', 11), ('now', 20), ('now', 30), ('before', 1), ('before', 2), ('before', 3)) t(state, n)"
ORACLES["backup_and_restore"] = "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey = 0 THEN 'first' ELSE n_name END AS name FROM nation"
ORACLES["export_places"] = """
SELECT 'INSERT (:`Region` {_id: ''region:' || r_regionkey || ''', `r_regionkey`: ' || r_regionkey || ', `r_name`: ''' || r_name || '''});' AS line FROM region
UNION ALL SELECT 'INSERT (:`Nation` {_id: ''nation:' || n_nationkey || ''', `n_nationkey`: ' || n_nationkey || ', `n_name`: ''' || n_name || ''', `n_regionkey`: ' || n_regionkey || '});' FROM nation
UNION ALL SELECT 'MATCH (a {_id: ''nation:' || n_nationkey || '''}), (b {_id: ''region:' || n_regionkey || '''}) INSERT (a)-[:`IN_REGION`]->(b);' FROM nation
"""
