"""Validation, lookup and incremental queries over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.operators import reconcile, search
from loomspark.sources.tables import read
from loomspark.streaming import incremental


def name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations found among customers by key, else by name."""
    part = read(spark, sf_dir, "part")
    nodes = part.select(F.concat_ws("/", "p_brand", "p_name").alias("key"), F.col("p_name").alias("name")).distinct()
    code = part.filter("p_size > 45").select(F.concat_ws("/", "p_brand", "p_name").alias("key"), F.upper("p_name").alias("name"), F.concat(F.lit("f"), "p_partkey").alias("path"))
    return reconcile.name_fallback(nodes, code)


def customer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 100 customers by name, ignoring case in the filter."""
    rows = search.containing(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_mktsegment", "build")
    return search.page(rows, [F.col("c_name"), F.col("c_custkey")], 100, 100)


def language_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and share of each language and source."""
    docs = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return docs.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(W.partitionBy("lang")), 6))


def copied_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines carried into the next snapshot, as file edges and as symbol edges: those of orders whose price and status are as before."""
    orders = read(spark, sf_dir, "orders")
    now = orders.select(F.col("o_orderkey").cast("string").alias("rel_path"), F.col("o_orderstatus").alias("checksum"), F.col("o_totalprice").alias("size_bytes"), F.col("o_orderdate").alias("mtime"))
    before = now.withColumn("checksum", F.when(F.col("size_bytes") > 250000, "X").otherwise(F.col("checksum")))
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_discount").alias("confidence_score"), F.col("l_returnflag").alias("resolution_method"))
    diff = search.manifest_diff(now, before)
    files, symbols = search.copy_unchanged(edges, diff, search.COPIED_FILE_EDGES), search.copy_unchanged(edges, diff)
    both = files.withColumn("kind", F.lit("file")).unionByName(symbols.withColumn("kind", F.lit("symbol")))
    return both.groupBy("src", "kind").agg(F.count("*").alias("n"), F.round(F.sum("confidence_score"), 6).alias("confidence"), F.min("resolution_method").alias("method"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: events by hour and type, by event time."""
    out = incremental.windowed_counts(read(spark, sf_dir, "events"))
    return out.select(F.col("window.start").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: each user's runs of events without a gap of over twelve hours."""
    return incremental.sessions(read(spark, sf_dir, "events"), "12 hours")


ORACLES = {
    "name_fallback": "WITH n AS (SELECT DISTINCT p_brand || '/' || p_name AS key, p_name AS name FROM part), c AS (SELECT p_brand || '/' || p_name AS key, upper(p_name) AS u, 'f' || p_partkey AS path FROM part WHERE p_size > 45), x AS (SELECT key, min(path) AS xp FROM c GROUP BY key), y AS (SELECT u, min(path) AS yp, count(DISTINCT path) AS k FROM c GROUP BY u) SELECT n.key, n.name, coalesce(xp, yp) AS path, CASE WHEN xp IS NOT NULL THEN 'exact' WHEN yp IS NOT NULL THEN 'name' ELSE 'none' END AS how, xp IS NULL AND coalesce(k, 0) > 1 AS ambiguous FROM n LEFT JOIN x ON n.key = x.key LEFT JOIN y ON upper(n.name) = y.u",
    "customer_page": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%build%' ORDER BY c_name, c_custkey LIMIT 100 OFFSET 100",
    "language_breakdown": "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(sum(n_chars) / sum(sum(n_chars)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY lang, source",
    "copied_edges": "WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) AS src, l_discount AS c, l_returnflag AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice <= 250000 OR o_orderstatus = 'X') SELECT src, 'file' AS kind, count(*) AS n, CAST(count(*) AS DOUBLE) AS confidence, 'import_statement' AS method FROM e GROUP BY src UNION ALL SELECT src, 'symbol', count(*), round(sum(c), 6), min(m) FROM e GROUP BY src",
    "hourly_events": "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "user_sessions": "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM b GROUP BY user_id, k",
}

QUERIES = {f.__name__: f for f in (name_fallback, customer_page, language_breakdown, copied_edges, hourly_events, user_sessions)}
