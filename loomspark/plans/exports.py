"""Exports of graphs as JSON documents, and deletion over dependent tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import exports, search
from loomspark.plans import graphs
from loomspark.sources.tables import cascade, checkpoint, read

#: Foreign keys of the given tables: table, column, table it points to, column there.
LINKS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("events", "user_id", "customer", "c_custkey"),
]


def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the eight tables before and after a region and some small parts are deleted with all that hangs on them."""
    tables = {name: read(spark, sf_dir, name) for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    left = cascade(tables, LINKS, {"region": F.col("r_regionkey") == 2, "part": (F.col("p_size") == 1) & (F.col("p_partkey") % 2 == 0)})
    out = None
    for name, df in tables.items():
        rows = df.agg(F.count("*").alias("before")).join(left[name].agg(F.count("*").alias("after"))).select(F.lit(name).alias("table_name"), "before", "after")  # one row each
        out = rows if out is None else out.union(rows)
    return out


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts; every seventh target lies outside."""
    e = graphs.symbol_edges(spark, sf_dir).select(T.symbol_file(F.col("src")).alias("src"), T.symbol_file(F.col("dst")).alias("dst"), "edge_type", F.round("confidence", 2).alias("confidence_score"))
    outside = F.substring("dst", 2, 20).cast("long") % 7 == 0
    made = e.withColumns({"external": outside, "dst": F.when(outside, F.concat(F.lit("__external__/"), "dst")).otherwise(F.col("dst"))})
    return made.withColumns({"resolution_method": F.lit("import_statement"), "resolution_class": F.when(F.col("external"), "external_runtime").otherwise("resolved")})


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").filter("p_size > 5").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_brand").alias("community"))


def exported_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of an export: parts of some names are left out, as are edges inside the code whose source is no node; those that lead outside stay."""
    kept = search.export_edges(_edges(spark, sf_dir), _nodes(spark, sf_dir), "^p1[0-9]*$")
    return kept.groupBy("src", "dst", "external").agg(F.count("*").alias("n"))


def code_graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the JSON document of a code graph: parts as nodes, brands as communities, nations by region as cycles."""
    nodes = checkpoint(_nodes(spark, sf_dir))
    edges = search.export_edges(_edges(spark, sf_dir), nodes, "^p1[0-9]*$")
    cycles = read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("component"), F.col("n_name").alias("node"))
    tests = read(spark, sf_dir, "part").filter("p_size = 1").select(F.concat(F.lit('tests/"'), "p_partkey").alias("path"))
    return exports.json_lines(exports.code_graph("snap\\1", nodes, edges, nodes, cycles, tests))


def document_graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the JSON document of a document graph: suppliers as nodes, nations' trade as edges, orders as assertions, bad accounts as mismatches."""
    supplier, orders, customer = (read(spark, sf_dir, t) for t in ("supplier", "orders", "customer"))
    nodes = supplier.select(F.col("s_suppkey").cast("long").alias("id"), F.lit("program").alias("node_type"), F.col("s_name").alias("display_name"))
    edges = supplier.select(F.concat_ws(">", "s_nationkey", "s_suppkey").alias("id"), F.col("s_nationkey").alias("src"), F.col("s_suppkey").alias("dst"))
    assertions = orders.filter("o_orderkey % 50 = 0").select(F.col("o_orderkey").cast("long").alias("id"), F.when(F.col("o_orderstatus") == "F", "dd").otherwise("bd").alias("side"), F.lit("calls").alias("predicate"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")).alias("object"))
    mismatches = customer.filter("c_acctbal < 0").select(F.col("c_custkey").cast("long").alias("id"), F.lit("value").alias("mismatch_type"))
    summary = supplier.agg(F.count("*").alias("node_count")).join(mismatches.agg(F.count("*").alias("mismatch_count")))  # one row each
    return exports.json_lines(exports.document_graph(summary, nodes, edges, assertions, mismatches))


_GRAPH = f"""{graphs._E},
x0 AS (SELECT src, CASE WHEN CAST(substr(dst, 2) AS BIGINT) % 7 = 0 THEN '__external__/' || dst ELSE dst END AS dst, edge_type, round(confidence, 2) AS confidence_score, CAST(substr(dst, 2) AS BIGINT) % 7 = 0 AS external FROM fe),
nd AS (SELECT 'p' || p_partkey AS node, p_brand AS community FROM part WHERE p_size > 5),
x AS (SELECT * FROM x0 WHERE NOT regexp_matches(src, '^p1[0-9]*$') AND NOT regexp_matches(dst, '^p1[0-9]*$') AND (external OR src IN (SELECT node FROM nd)))"""
_GONE = """
na AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2), cu AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM na)), su AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (FROM na)),
od AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM cu)), pt AS (SELECT p_partkey FROM part WHERE p_size = 1 AND p_partkey % 2 = 0)"""
_LIST = lambda k, name, rows, last="": f"""SELECT {k} AS section, 0 AS part, '' AS key, '{"{" if k == 0 else ","}"{name}":[' AS line UNION ALL SELECT {k}, 2, '', ']{last}'
UNION ALL SELECT {k}, 1, key, CASE WHEN key = (SELECT min(key) FROM {rows}) THEN '' ELSE ',' END || json FROM {rows}"""  # noqa: E731
ORACLES = {
    "cascade_counts": f"""WITH {_GONE}
SELECT 'region' AS table_name, count(*) AS before, count(*) FILTER (r_regionkey <> 2) AS after FROM region UNION ALL SELECT 'nation', count(*), count(*) FILTER (n_regionkey <> 2) FROM nation
UNION ALL SELECT 'customer', count(*), count(*) FILTER (c_nationkey NOT IN (FROM na)) FROM customer UNION ALL SELECT 'supplier', count(*), count(*) FILTER (s_nationkey NOT IN (FROM na)) FROM supplier
UNION ALL SELECT 'part', count(*), count(*) FILTER (p_partkey NOT IN (FROM pt)) FROM part UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_custkey NOT IN (FROM cu)) FROM orders
UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (l_orderkey NOT IN (FROM od) AND l_suppkey NOT IN (FROM su) AND l_partkey NOT IN (FROM pt)) FROM lineitem UNION ALL SELECT 'events', count(*), count(*) FILTER (user_id NOT IN (FROM cu)) FROM events""",
    "exported_edges": f"WITH {_GRAPH} SELECT src, dst, external, count(*) AS n FROM x GROUP BY ALL",
    "code_graph_export": f"""WITH {_GRAPH},
g AS (SELECT src, dst, edge_type, external, max(confidence_score) AS cs FROM x GROUP BY ALL), ev AS (SELECT node FROM nd UNION SELECT dst FROM x WHERE external),
be AS (SELECT a.community AS sc, b.community AS dc, count(*) AS n FROM g JOIN nd a ON a.node = src JOIN nd b ON b.node = dst WHERE NOT external AND a.community <> b.community GROUP BY ALL),
r_n AS (SELECT node AS key, '"' || node || '"' AS json FROM ev), r_e AS (SELECT src || chr(1) || dst || chr(1) || edge_type || chr(1) || external AS key, '{{"src":"' || src || '","dst":"' || dst || '","edge_type":"' || edge_type || '","external":' || external || ',"confidence_score":' || cs || ',"resolution_method":"import_statement","resolution_class":"' || CASE WHEN external THEN 'external_runtime' ELSE 'resolved' END || '"}}' AS json FROM g),
r_b AS (SELECT lpad(CAST(1000000000000000000 - n AS VARCHAR), 19, '0') || chr(1) || sc || chr(1) || dc AS key, '{{"src_community":"' || sc || '","dst_community":"' || dc || '","edge_count":' || n || '}}' AS json FROM be),
r_c AS (SELECT 'r' || n_regionkey AS key, '["' || string_agg(n_name, '","' ORDER BY n_name) || '"]' AS json FROM nation GROUP BY 1), r_t AS (SELECT 'tests/"' || p_partkey AS key, '"tests/\\"' || p_partkey || '"' AS json FROM part WHERE p_size = 1),
r_m AS (SELECT node AS key, '"' || node || '":"' || community || '"' AS json FROM nd), r_g AS (SELECT community AS key, '"' || community || '":["' || string_agg(node, '","' ORDER BY node) || '"]' AS json FROM nd GROUP BY 1)
SELECT 0 AS section, 1 AS part, '' AS key, '{{"snapshot_id":"snap\\\\1"' AS line
UNION ALL SELECT 1, 1, '', ',"stats":{{"node_count":' || (SELECT count(*) FROM ev) || ',"total_edge_count":' || (SELECT count(*) FROM g) || ',"internal_edge_count":' || (SELECT count(*) FROM g WHERE NOT external) || ',"community_count":' || (SELECT count(DISTINCT community) FROM nd) || ',"singleton_community_count":' || (SELECT count(*) FROM (SELECT community FROM nd GROUP BY 1 HAVING count(*) = 1)) || ',"cycle_count":' || (SELECT count(*) FROM r_c) || ',"test_file_count":' || (SELECT count(*) FROM r_t) || '}}'
UNION ALL {_LIST(2, "nodes", "r_n")} UNION ALL {_LIST(3, "edges", "r_e")}
UNION ALL {_LIST(4, "communities", "r_m").replace(":['", ":{'").replace("']'", "'}'")} UNION ALL {_LIST(5, "community_groups", "r_g").replace(":['", ":{'").replace("']'", "'}'")}
UNION ALL {_LIST(6, "community_edges", "r_b")} UNION ALL {_LIST(7, "cycles", "r_c")} UNION ALL {_LIST(8, "test_files", "r_t", "}")}""",
    "document_graph_export": f"""WITH r_n AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 20, '0') AS key, '{{"node_type":"program","display_name":"' || s_name || '"}}' AS json FROM supplier), r_e AS (SELECT s_nationkey || '>' || s_suppkey AS key, '{{"src":' || s_nationkey || ',"dst":' || s_suppkey || '}}' AS json FROM supplier),
r_a AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS key, '{{"side":"' || CASE WHEN o_orderstatus = 'F' THEN 'dd' ELSE 'bd' END || '","predicate":"calls","object":' || CASE WHEN o_custkey % 3 > 0 THEN '"' || o_orderpriority || '"' ELSE 'null' END || '}}' AS json FROM orders WHERE o_orderkey % 50 = 0),
r_m AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 20, '0') AS key, '{{"mismatch_type":"value"}}' AS json FROM customer WHERE c_acctbal < 0)
SELECT 0 AS section, 1 AS part, '' AS key, '{{"summary":{{"node_count":' || (SELECT count(*) FROM supplier) || ',"mismatch_count":' || (SELECT count(*) FROM r_m) || '}}' AS line
UNION ALL {_LIST(1, "nodes", "r_n")} UNION ALL {_LIST(2, "edges", "r_e")} UNION ALL {_LIST(3, "assertions", "r_a")} UNION ALL {_LIST(4, "mismatches", "r_m", "}")}""",
}
QUERIES = {f.__name__: f for f in (cascade_counts, exported_edges, code_graph_export, document_graph_export)}
