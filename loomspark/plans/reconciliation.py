"""Documents against code on the given tables, with their SQL.

Entities: documents claim, labels are the code side.  Relations: an order's priority group claims lines, lineitem
holds them.  Validation: orders are the basic design, lineitem the detailed one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import reconcile
from loomspark.sources.tables import read

VERDICTS = ["matched", "undocumented", "missing", "unknown"]


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents")
    doc = docs.filter("lang <> 'es'").select(F.col("lang").alias("entity_type"), F.col("doc_id").cast("string").alias("key"))
    code = read(spark, sf_dir, "labels").join(docs.select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("entity_type"), F.col("doc_id").cast("string").alias("key"))
    return doc, code


def entity_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every entity of either side (documents in Spanish leave theirs undocumented)."""
    return reconcile.compare_entities(*_sides(spark, sf_dir))


_ENTITY = """
d AS (SELECT DISTINCT lang AS entity_type, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE lang <> 'es'),
c AS (SELECT DISTINCT lang AS entity_type, CAST(doc_id AS VARCHAR) AS key FROM labels JOIN documents USING (doc_id)),
v AS (SELECT coalesce(d.entity_type, c.entity_type) AS entity_type, coalesce(d.key, c.key) AS key, CASE WHEN d.key IS NULL THEN 'undocumented' WHEN c.key IS NOT NULL THEN 'matched' ELSE 'missing' END AS verdict FROM d FULL JOIN c ON d.entity_type = c.entity_type AND d.key = c.key)
"""


def entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict counts of each type and in all."""
    return reconcile.verdict_summary(entity_compare(spark, sf_dir), "entity_type", VERDICTS)


def diagnostics_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of each user, and whether all are ok (no error last)."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("rel_path"), F.struct("ts", "event_id").alias("id"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    gate = reconcile.authoritative(events.select("rel_path"), events)
    return reconcile.last_status(events).join(F.broadcast(gate)).select("rel_path", "status", "authoritative")


def _relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    key = lambda c: F.concat(F.lit("order/"), c)
    code = lines.groupBy(key(F.col("l_orderkey")).alias("subject"), F.concat(F.lit("part/"), F.col("l_partkey")).alias("object")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("sites")).withColumn("predicate", F.lit("calls"))
    # the documents list the large lines and count the returned ones
    claimed = lines.groupBy("l_orderkey", "l_partkey").agg(F.sort_array(F.collect_list(F.when(F.col("l_quantity") > 10, F.col("l_linenumber")))).alias("sites"), F.count_if(F.col("l_returnflag") == "R").cast("int").alias("value"))
    shifted = claimed.select(key(F.col("l_orderkey")).alias("subject"), F.concat(F.lit("part/"), F.when(F.size("sites") > 0, F.col("l_partkey")).otherwise(F.col("l_partkey") + F.col("value"))).alias("object"), "sites", "value")
    doc = shifted.select(F.lit("calls").alias("predicate"), "subject", "object", F.when(F.col("value") > 0, "bd").otherwise("dd").alias("side"), "sites", "value")
    status = orders.select(key(F.col("o_orderkey")).alias("subject"), (F.col("o_orderstatus") != "P").alias("ok")).distinct()
    return doc, code, status


def relation_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and multiplicity of every claimed or found relation."""
    return reconcile.compare_relations(*_relations(spark, sf_dir))


_RELATION = """
code AS (SELECT 'order/' || l_orderkey AS subject, 'part/' || l_partkey AS object, list_sort(list(l_linenumber)) AS sites FROM lineitem GROUP BY l_orderkey, l_partkey),
cl AS (SELECT l_orderkey, l_partkey, list_sort(list(l_linenumber) FILTER (l_quantity > 10)) AS sites0, count(*) FILTER (l_returnflag = 'R') AS value FROM lineitem GROUP BY l_orderkey, l_partkey),
doc AS (SELECT 'order/' || l_orderkey AS subject, 'part/' || CASE WHEN len(coalesce(sites0, [])) > 0 THEN l_partkey ELSE l_partkey + value END AS object, CASE WHEN value > 0 THEN 'bd' ELSE 'dd' END AS side, coalesce(sites0, []) AS sites, value FROM cl),
st AS (SELECT DISTINCT 'order/' || o_orderkey AS subject, o_orderstatus <> 'P' AS ok FROM orders),
rel AS (
  SELECT doc.subject, doc.object, doc.side, CASE WHEN code.subject IS NOT NULL THEN 'MATCH' WHEN coalesce(st.ok, false) THEN 'DOC_ONLY' ELSE 'UNKNOWN' END AS verdict,
    CASE WHEN code.subject IS NULL THEN 'NOT_APPLICABLE' WHEN len(doc.sites) > 0 THEN CASE WHEN doc.sites = code.sites THEN 'EXACT_SITE_MATCH' ELSE 'COUNT_MISMATCH' END WHEN doc.value = len(code.sites) THEN 'COUNT_ONLY_MATCH' ELSE 'COUNT_MISMATCH' END AS multiplicity
  FROM doc LEFT JOIN code USING (subject, object) LEFT JOIN st ON doc.subject = st.subject
  UNION ALL SELECT code.subject, code.object, NULL, 'UNKNOWN', 'NOT_APPLICABLE' FROM code WHERE NOT EXISTS (SELECT 1 FROM doc WHERE doc.subject = code.subject AND doc.object = code.object)
)
"""


def relation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of verdicts by multiplicity and in all."""
    return reconcile.verdict_summary(relation_compare(spark, sf_dir), "multiplicity", ["MATCH", "DOC_ONLY", "UNKNOWN"])


def existence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and nations that the one side names and the open orders and suppliers of the other lack."""
    bd = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("subject"), F.concat(F.lit("nation/"), "c_nationkey").alias("object"), F.when(F.col("c_acctbal") < 0, "external").otherwise("asserted").alias("status"))
    dd = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("customer/"), "o_custkey").alias("subject"), F.concat(F.lit("order/"), "o_orderkey").alias("object"))
    dd = dd.unionByName(read(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier/"), "s_suppkey").alias("subject"), F.concat(F.lit("nation/"), "s_nationkey").alias("object")))
    found = reconcile.existence(bd, dd)
    return found.withColumn("fingerprint", reconcile.fingerprint(F.col("mismatch_type"), F.col("subject"), F.lit(None).cast("string"), F.lit(None).cast("string")))


def value_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose counted lines differ from the number of the last line."""
    lines = read(spark, sf_dir, "lineitem")
    bd = lines.groupBy(F.col("l_orderkey").cast("string").alias("subject")).agg(F.count("*").cast("int").alias("value")).select("subject", F.lit("lines").alias("object"), F.lit("calls").alias("predicate"), "value")
    dd = lines.select(F.col("l_orderkey").cast("string").alias("subject"), F.lit("lines").alias("object"), F.lit("calls").alias("predicate"), F.col("l_linenumber").alias("value"), F.struct("l_shipdate", "l_linenumber").alias("id"))
    return reconcile.value_mismatch(bd, dd)


def unique_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names resolved to a brand: resolved if one has it, ambiguous if several, else external."""
    part = read(spark, sf_dir, "part")
    refs = part.select(F.col("p_partkey").cast("string").alias("src_path"), F.concat_ws("/", "p_name", "p_size").alias("name"))
    index = part.filter("p_type <> 'SMALL'").select(F.concat_ws("/", "p_name", "p_size").alias("name"), F.col("p_brand").alias("path"))
    return reconcile.resolve_unique(refs, index, "cobol_call_literal", "ambiguous_program_id", "program_not_in_snapshot", "program")


def first_seen_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return reconcile.first_seen(events, ["user_id", "event_type"], "event_id")


def coverage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order priority and status, the suppliers' nations that its orders reach."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    assertions = lines.select(F.col("o_orderpriority").alias("doc_id"), F.col("o_orderstatus").alias("section_id"), F.lit(None).cast("string").alias("subject"), F.concat(F.lit("nation/"), "s_nationkey").alias("object")).distinct()
    nodes = read(spark, sf_dir, "nation").filter("n_regionkey <> 0").select(F.concat(F.lit("nation/"), "n_nationkey").alias("node"))
    return reconcile.coverage_groups(assertions, nodes).select("doc_id", "section_id", F.array_join("nodes", ",").alias("nodes"))


ORACLES = {
    "entity_compare": f"WITH {_ENTITY} SELECT * FROM v",
    "entity_summary": f"WITH {_ENTITY} SELECT coalesce(entity_type, '(all)') AS entity_type, count(*) FILTER (verdict = 'matched') AS matched, count(*) FILTER (verdict = 'undocumented') AS undocumented, count(*) FILTER (verdict = 'missing') AS missing, count(*) FILTER (verdict = 'unknown') AS unknown FROM v GROUP BY ROLLUP (entity_type)",
    "diagnostics_gate": "WITH s AS (SELECT CAST(user_id AS VARCHAR) AS rel_path, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT rel_path, status, (SELECT bool_and(status = 'ok') FROM s) AS authoritative FROM s",
    "relation_compare": f"WITH {_RELATION} SELECT 'calls' AS predicate, * FROM rel",
    "relation_summary": f"WITH {_RELATION} SELECT coalesce(multiplicity, '(all)') AS multiplicity, count(*) FILTER (verdict = 'MATCH') AS \"MATCH\", count(*) FILTER (verdict = 'DOC_ONLY') AS \"DOC_ONLY\", count(*) FILTER (verdict = 'UNKNOWN') AS \"UNKNOWN\" FROM rel GROUP BY ROLLUP (multiplicity)",
    "existence_check": "WITH b AS (SELECT DISTINCT unnest(['customer/' || c_custkey, 'nation/' || c_nationkey]) AS subject FROM customer WHERE c_acctbal >= 0 OR c_acctbal IS NULL), d AS (SELECT 'customer/' || o_custkey AS s FROM orders WHERE o_orderstatus = 'P' UNION SELECT 'order/' || o_orderkey FROM orders UNION SELECT 'supplier/' || s_suppkey FROM supplier UNION SELECT 'nation/' || s_nationkey FROM supplier) SELECT 'existence' AS mismatch_type, 'error' AS severity, subject, sha256('existence:' || subject || ':null:null') AS fingerprint FROM b WHERE subject NOT IN (SELECT s FROM d)",
    "value_mismatch": "WITH b AS (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS value FROM lineitem GROUP BY l_orderkey), d AS (SELECT l_orderkey, l_linenumber AS dd_value FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) = 1) SELECT 'value' AS mismatch_type, 'warning' AS severity, CAST(l_orderkey AS VARCHAR) AS subject, 'lines' AS object, value, dd_value FROM b JOIN d USING (l_orderkey) WHERE value <> 0 AND dd_value <> 0 AND value <> dd_value",
    "unique_resolution": "WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS src_path, p_name || '/' || p_size AS name FROM part), i AS (SELECT p_name || '/' || p_size AS name, count(DISTINCT p_brand) AS n, min(p_brand) AS path FROM part WHERE p_type <> 'SMALL' GROUP BY 1) SELECT src_path, name, CASE WHEN n = 1 THEN path ELSE '__external__/program/' || name END AS dst_path, CASE WHEN n = 1 THEN 'cobol_call_literal' WHEN n > 1 THEN 'ambiguous_program_id' ELSE 'program_not_in_snapshot' END AS resolution_method, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence_score, coalesce(n, 0) <> 1 AS is_external FROM r LEFT JOIN i USING (name)",
    "first_seen_labels": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
    "coverage_groups": "WITH a AS (SELECT DISTINCT o_orderpriority AS doc_id, o_orderstatus AS section_id, 'nation/' || s_nationkey AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey), n AS (SELECT 'nation/' || n_nationkey AS node FROM nation WHERE n_regionkey <> 0) SELECT doc_id, section_id, string_agg(node, ',' ORDER BY node) AS nodes FROM a JOIN n USING (node) GROUP BY ALL",
}

QUERIES = {f.__name__: f for f in (entity_compare, entity_summary, diagnostics_gate, relation_compare, relation_summary, existence_check, value_mismatch, unique_resolution, first_seen_labels, coverage_groups)}
