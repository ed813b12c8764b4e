"""Graph queries over parts that are returned together, with their SQL.

Edges join all consecutive lines of an order: from the part of the one line to the part of the next.  A symbol is
part::supplier, confidence is 1 - discount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions import text as T
from loomspark.operators import communities, graph
from loomspark.sources.tables import checkpoint, read


def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, confidence, edge_type, line): symbol edges, one for each pair of consecutive lines."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_quantity", "l_linestatus")
    own = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    symbol = F.concat(F.lit("p"), F.col("l_partkey"), F.lit("::"), F.col("l_suppkey"))
    rows = lines.withColumn("src", symbol).withColumn("dst", F.lead("src").over(own)).filter("dst is not null")
    return rows.select("src", "dst", F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.when(F.col("l_linestatus") == "F", "calls").otherwise("extends").alias("edge_type"), F.col("l_linenumber").alias("line"))


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): the parts of the symbol edges, repeated edges kept."""
    return symbol_edges(spark, sf_dir).select(T.symbol_file(F.col("src")).alias("src"), T.symbol_file(F.col("dst")).alias("dst"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of one brand as starting points."""
    return read(spark, sf_dir, "part").filter("p_brand = 'Brand#7'").select(F.concat(F.lit("p"), "p_partkey").alias("node"))


_E = """
o AS (SELECT *, 'p' || l_partkey || '::' || l_suppkey AS s FROM lineitem),
n AS (SELECT s AS src, lead(s) OVER x AS dst, round(1 - l_discount, 2) AS confidence, CASE WHEN l_linestatus = 'F' THEN 'calls' ELSE 'extends' END AS edge_type, l_linenumber AS line
  FROM o WINDOW x AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount)),
se AS (SELECT src, dst, confidence, edge_type, line FROM n WHERE dst IS NOT NULL),
fe AS (SELECT split_part(src, '::', 1) AS src, split_part(dst, '::', 1) AS dst, confidence, edge_type FROM se),
un AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM fe UNION ALL SELECT dst, src FROM fe) WHERE src <> dst),
sd AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_brand = 'Brand#7')
"""


def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(file_edges(spark, sf_dir))


def central_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most central parts."""
    return graph.central(file_edges(spark, sf_dir)).select("node", "rank", "score", "indegree")


def neighbourhood_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts within two undirected hops of each seed, at most 300 each."""
    return graph.neighbourhood(file_edges(spark, sf_dir), seeds(spark, sf_dir), 2)


def neighbourhood_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of each seed's neighbourhood of two hops and 60 parts, 40 at most."""
    e = symbol_edges(spark, sf_dir)
    flat = checkpoint(e.select(T.symbol_file(F.col("src")).alias("src"), T.symbol_file(F.col("dst")).alias("dst"), "edge_type", F.round("confidence", 6).alias("confidence")))
    return graph.neighbourhood_edges(flat, graph.neighbourhood(flat, seeds(spark, sf_dir), 2, 60), 2, 40)


def impact_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts within two hops of each seed, with the hop against the edges."""
    return graph.impact_cone(file_edges(spark, sf_dir), seeds(spark, sf_dir), 2)


def reverse_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leads to each seed within three hops."""
    return graph.reverse_cone(file_edges(spark, sf_dir), seeds(spark, sf_dir), 3)


def symbol_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that lead to those of the seed parts within four confident hops."""
    e = symbol_edges(spark, sf_dir)
    start = e.select(F.col("dst").alias("node")).distinct().join(seeds(spark, sf_dir).withColumnRenamed("node", "f"), T.symbol_file(F.col("node")) == F.col("f"), "left_semi")
    return graph.symbol_cone(e, start, 4, 0.92, ["calls", "extends"])


def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first shortest path from each seed to every part within two hops."""
    e = file_edges(spark, sf_dir)
    reach = graph.hops(e, seeds(spark, sf_dir), 2)
    found = graph.shortest_paths(e, reach.select(F.col("seed").alias("src"), F.col("node").alias("dst")), 2)
    return found.select("src", "dst", F.array_join("path", ">").alias("path"))


def callees_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident symbol edges out of and into the seed parts; an edge inside one shows in both directions."""
    e, s = symbol_edges(spark, sf_dir), seeds(spark, sf_dir).withColumnRenamed("node", "file")
    out = graph.callees(e, s, 0.95).withColumn("direction", F.lit("outgoing"))
    return out.unionByName(graph.callers(e, s, 0.95).withColumn("direction", F.lit("incoming"))).select("direction", "src", "dst", "edge_type", "line", F.round("confidence", 6).alias("confidence"))


def call_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files reached by calls from each seed in up to three steps, with the confidence along the listing."""
    e = symbol_edges(spark, sf_dir)
    flat = e.select(T.symbol_file(F.col("src")).alias("src_file"), T.symbol_file(F.col("dst")).alias("dst_file"), F.col("dst").alias("symbol"), "confidence")
    return graph.call_chain(flat, seeds(spark, sf_dir), 3).select("seed", "file", "step", "n_symbols", F.round("path_confidence", 6).alias("path_confidence"))


def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that lie on cycles, by cycle."""
    return graph.strong_components(file_edges(spark, sf_dir)).select("node", "component", F.col("size").cast("long").alias("size"))


def merged_symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each symbol edge: its lines and its best confidence."""
    from loomspark.operators.reconcile import merge_symbol_edges

    e = symbol_edges(spark, sf_dir).select("src", "dst", "edge_type", "confidence", F.array("line").alias("lines"))
    return merge_symbol_edges(e).select("src", "dst", "edge_type", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), F.round("confidence", 6).alias("confidence"))


def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the part graph: size, hubs and modularity of each."""
    e = checkpoint(file_edges(spark, sf_dir))  # read twice
    labels = communities.detect(communities.prepared_edges(e), resolution=1.0)
    return communities.summaries(e, labels).select("community", "members", "internal_edges", F.array_join("hub_nodes", ",").alias("hub_nodes"), "neighbours", F.array_join("neighbour_communities", ",").alias("neighbour_communities"), F.round("modularity", 6).alias("modularity"))


def _nation_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Trade between nations (customer's to supplier's) and their regions as given communities."""
    read_ = lambda t: read(spark, sf_dir, t)
    trade = read_("lineitem").select("l_orderkey", "l_suppkey").join(read_("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    trade = trade.join(read_("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(read_("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = trade.select(F.col("c_nationkey").cast("string").alias("src"), F.col("s_nationkey").cast("string").alias("dst"))
    labels = read_("nation").join(read_("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("node"), F.col("r_name").alias("community"))
    return edges, labels


def community_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as communities of the trade between nations."""
    edges, labels = _nation_labels(spark, sf_dir)
    return communities.summaries(edges, labels).select("community", "members", "internal_edges", F.array_join("hub_nodes", ",").alias("hub_nodes"), "neighbours", F.array_join("neighbour_communities", ",").alias("neighbour_communities"), F.round("modularity", 6).alias("modularity"))


def community_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade lines between regions."""
    return communities.between(*_nation_labels(spark, sf_dir))


_TRADE = """
tr AS (SELECT CAST(c_nationkey AS VARCHAR) AS src, CAST(s_nationkey AS VARCHAR) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
lb AS (SELECT CAST(n_nationkey AS VARCHAR) AS node, r_name AS community FROM nation JOIN region ON n_regionkey = r_regionkey),
pl AS (SELECT src, dst, a.community AS ca, b.community AS cb FROM tr JOIN lb a ON src = a.node JOIN lb b ON dst = b.node)
"""


def _level(k: int) -> str:
    """Files that are first reached at step k, from those of step k - 1, for seeds that hold at most 30 files by then."""
    before = " UNION ALL ".join(f"SELECT seed, file FROM l{i}" for i in range(k))
    return (
        f"s{k} AS ({before}), l{k} AS (SELECT l.seed, e.b AS file, {k} AS step, max(e.c) AS best, count(DISTINCT e.symbol) AS n_symbols FROM l{k - 1} l JOIN ce e ON l.file = e.a "
        f"WHERE l.seed IN (SELECT seed FROM s{k} GROUP BY seed HAVING count(*) <= 30) AND NOT EXISTS (SELECT 1 FROM s{k} x WHERE x.seed = l.seed AND x.file = e.b) GROUP BY l.seed, e.b)"
    )


_CHAIN = f"""WITH {_E}, c0 AS (SELECT split_part(src, '::', 1) AS a, split_part(dst, '::', 1) AS b, dst AS symbol, confidence AS c FROM se), ce AS (SELECT * FROM c0 WHERE a <> b),
l0 AS (SELECT DISTINCT node AS seed, node AS file, 0 AS step, 1.0 AS best, 0 AS n_symbols FROM sd), {_level(1)}, {_level(2)}, {_level(3)},
every AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
SELECT seed, file, CAST(step AS INTEGER) AS step, CAST(n_symbols AS INTEGER) AS n_symbols, round(product(CAST(best AS DOUBLE)) OVER (PARTITION BY seed ORDER BY step, file ROWS UNBOUNDED PRECEDING), 6) AS path_confidence FROM every"""

ORACLES = {
    "call_chain": _CHAIN,
    "degree_centrality": f"WITH {_E}, d AS (SELECT src AS node, 0 AS i, 1 AS o FROM fe UNION ALL SELECT dst, 1, 0 FROM fe) SELECT node, CAST(sum(i) AS BIGINT) AS indegree, CAST(sum(o) AS BIGINT) AS outdegree, CAST(3 * sum(i) + sum(o) AS BIGINT) AS score FROM d GROUP BY node",
    "central_files": f"WITH {_E}, d AS (SELECT src AS node, 0 AS i, 1 AS o FROM fe UNION ALL SELECT dst, 1, 0 FROM fe), g AS (SELECT node, CAST(sum(i) AS BIGINT) AS indegree, CAST(3 * sum(i) + sum(o) AS BIGINT) AS score FROM d GROUP BY node) SELECT node, CAST(row_number() OVER (ORDER BY score DESC, indegree DESC, node) - 1 AS INTEGER) AS rank, score, indegree FROM g QUALIFY row_number() OVER (ORDER BY score DESC, indegree DESC, node) <= 30",
    "neighbourhood_2hop": f"WITH RECURSIVE {_E}, r AS (SELECT node AS seed, node, 0 AS hop FROM sd UNION SELECT r.seed, un.dst, r.hop + 1 FROM r JOIN un ON r.node = un.src WHERE r.hop < 2), m AS (SELECT seed, node, min(hop) AS hop FROM r GROUP BY ALL) SELECT seed, node, CAST(hop AS INTEGER) AS hop FROM m QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hop, node) <= 300",
    "neighbourhood_edges": f"WITH RECURSIVE {_E}, r AS (SELECT node AS seed, node, 0 AS hop FROM sd UNION SELECT r.seed, un.dst, r.hop + 1 FROM r JOIN un ON r.node = un.src WHERE r.hop < 2), m0 AS (SELECT seed, node, min(hop) AS hop FROM r GROUP BY ALL), m AS (SELECT * FROM m0 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hop, node) <= 60), j AS (SELECT a.seed, src, dst, edge_type, confidence, least(a.hop, b.hop) AS x, greatest(a.hop, b.hop) AS y FROM fe JOIN m a ON a.node = src JOIN m b ON b.node = dst AND b.seed = a.seed WHERE least(a.hop, b.hop) < 2) SELECT seed, src, dst, edge_type, confidence FROM j QUALIFY row_number() OVER (PARTITION BY seed ORDER BY x, y, src, dst, edge_type, confidence) <= 40",
    "impact_cone": f"WITH RECURSIVE {_E}, r AS (SELECT node AS seed, node, 0 AS hop FROM sd UNION SELECT r.seed, un.dst, r.hop + 1 FROM r JOIN un ON r.node = un.src WHERE r.hop < 2), m AS (SELECT seed, node, min(hop) AS ring FROM r GROUP BY ALL), b AS (SELECT node AS seed, node, 0 AS hop FROM sd UNION SELECT b.seed, fe.src, b.hop + 1 FROM b JOIN fe ON b.node = fe.dst WHERE b.hop < 2), bm AS (SELECT seed, node, min(hop) AS hop FROM b GROUP BY ALL), k AS (SELECT seed, node FROM m QUALIFY row_number() OVER (PARTITION BY seed ORDER BY ring, node) <= 500) SELECT k.seed, k.node, CAST(bm.hop AS INTEGER) AS hop FROM k LEFT JOIN bm ON k.seed = bm.seed AND k.node = bm.node",
    "reverse_cone": f"WITH RECURSIVE {_E}, b AS (SELECT DISTINCT node AS seed, fe.src AS node, 1 AS hop FROM sd JOIN fe ON sd.node = fe.dst UNION SELECT b.seed, fe.src, b.hop + 1 FROM b JOIN fe ON b.node = fe.dst WHERE b.hop < 3) SELECT seed, node, CAST(min(hop) AS INTEGER) AS hop FROM b GROUP BY ALL",
    "symbol_cone": f"WITH RECURSIVE {_E}, st AS (SELECT DISTINCT dst AS node FROM se WHERE split_part(dst, '::', 1) IN (SELECT node FROM sd)), b AS (SELECT node AS seed, node, 0 AS hop FROM st UNION SELECT b.seed, se.src, b.hop + 1 FROM b JOIN se ON b.node = se.dst AND se.confidence >= 0.92 WHERE b.hop < 4) SELECT seed, node, CAST(min(hop) AS INTEGER) AS hop FROM b GROUP BY ALL",
    "shortest_paths": f"WITH RECURSIVE {_E}, de AS (SELECT DISTINCT src, dst FROM fe), r AS (SELECT DISTINCT node AS seed, node, [node] AS path, 0 AS hop FROM sd UNION ALL SELECT r.seed, de.dst, list_append(r.path, de.dst), r.hop + 1 FROM r JOIN de ON r.node = de.src WHERE r.hop < 2), m AS (SELECT seed, node, path, row_number() OVER (PARTITION BY seed, node ORDER BY hop, path) AS i FROM r) SELECT seed AS src, node AS dst, CASE WHEN seed = node THEN '' ELSE array_to_string(path, '>') END AS path FROM m WHERE i = 1",
    "callees_callers": f"WITH {_E} SELECT 'outgoing' AS direction, src, dst, edge_type, line, confidence FROM se WHERE confidence >= 0.95 AND split_part(src, '::', 1) IN (SELECT node FROM sd) UNION ALL SELECT 'incoming', src, dst, edge_type, line, confidence FROM se WHERE confidence >= 0.95 AND split_part(dst, '::', 1) IN (SELECT node FROM sd)",
    "strong_components": f"WITH RECURSIVE {_E}, de AS (SELECT DISTINCT src, dst FROM fe WHERE src <> dst), r AS (SELECT src AS a, dst AS b FROM de UNION SELECT r.a, de.dst FROM r JOIN de ON r.b = de.src), k AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a), c AS (SELECT a AS node, least(a, min(b)) AS component FROM k GROUP BY a) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c QUALIFY count(*) OVER (PARTITION BY component) > 1",
    "merged_symbol_edges": f"WITH {_E} SELECT src, dst, edge_type, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines, max(confidence) AS confidence FROM se GROUP BY src, dst, edge_type",
    "community_summaries": f"WITH {_TRADE}, ed AS (SELECT * FROM pl WHERE src <> dst), mm AS (SELECT count(*) AS m FROM ed), i AS (SELECT ca AS community, count(*) AS internal_edges FROM ed WHERE ca = cb GROUP BY ca), dg AS (SELECT community, count(*) AS d FROM (SELECT ca AS community FROM ed UNION ALL SELECT cb FROM ed) GROUP BY community), hs AS (SELECT lb.node, lb.community, count(ed.dst) AS s FROM lb LEFT JOIN ed ON ed.dst = lb.node AND ed.ca = ed.cb GROUP BY ALL), h AS (SELECT community, string_agg(node, ',' ORDER BY r) AS hub_nodes FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY s DESC, node) AS r FROM hs) WHERE r <= 3 GROUP BY community), nb AS (SELECT community, count(*) AS neighbours, string_agg(n, ',' ORDER BY n) AS neighbour_communities FROM (SELECT DISTINCT ca AS community, cb AS n FROM ed WHERE ca <> cb UNION SELECT DISTINCT cb, ca FROM ed WHERE ca <> cb) GROUP BY community), mb AS (SELECT community, count(*) AS members FROM lb GROUP BY community) SELECT mb.community, members, coalesce(internal_edges, 0) AS internal_edges, hub_nodes, coalesce(neighbours, 0) AS neighbours, coalesce(neighbour_communities, '') AS neighbour_communities, round(coalesce(internal_edges, 0) / m - (coalesce(d, 0) / (2 * m)) ** 2, 6) AS modularity FROM mb JOIN h USING (community) LEFT JOIN i USING (community) LEFT JOIN dg USING (community) LEFT JOIN nb USING (community), mm",
    "community_edges": f"WITH {_TRADE} SELECT ca AS src_community, cb AS dst_community, count(*) AS n FROM pl WHERE ca <> cb GROUP BY ca, cb",
}

QUERIES = {f.__name__: f for f in (degree_centrality, central_files, neighbourhood_2hop, neighbourhood_edges, impact_cone, reverse_cone, symbol_cone, shortest_paths, callees_callers, call_chain, strong_components, merged_symbol_edges, louvain_communities, community_summaries, community_edges)}
