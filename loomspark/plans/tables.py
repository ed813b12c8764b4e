"""Manifest, search, listing and link queries over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import paths as P
from loomspark.functions import text as T
from loomspark.operators import search
from loomspark.operators.reconcile import resolve_suffix
from loomspark.sources.tables import insert_or_ignore, read, upsert, without

LINK = r'href="([^"]+)"'


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/<id>.<extension by language>."""
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".py").when(F.col("lang") == "fr", ".json").otherwise(".cbl")
    return read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", F.concat(F.concat_ws("/", "source", "lang", "doc_id"), ext).alias("path"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a manifest row: language, category, size and checksum."""
    f = P.with_language(_files(spark, sf_dir), "path")
    return f.select(F.col("path").alias("rel_path"), "language", P.category(F.col("path")).alias("category"), F.octet_length("text").cast("long").alias("size_bytes"), F.sha1("text").alias("checksum"))


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents now against an earlier snapshot: without the last source, texts of long files as they were cut then."""
    now = _files(spark, sf_dir).select(F.col("path").alias("rel_path"), F.md5("text").alias("checksum"), F.col("n_chars").alias("size_bytes"), F.lit(0).alias("mtime"))
    before = _files(spark, sf_dir).filter("path not like 'src1/%'").select(F.col("path").alias("rel_path"), F.md5(F.when(F.col("n_chars") > 5000, F.upper("text")).otherwise(F.col("text"))).alias("checksum"), F.col("n_chars").alias("size_bytes"), F.lit(0).alias("mtime"))
    return search.manifest_diff(now.filter("rel_path not like 'src2/%'"), before)


def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files and the directories above them."""
    return search.path_tree(_files(spark, sf_dir).select("path"))


def suffix_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lang/id.ext ending resolved to the smallest path that ends so."""
    f = _files(spark, sf_dir)
    targets = f.select("doc_id", F.concat_ws("/", F.element_at(F.split("path", "/"), 2), F.element_at(F.split("path", "/"), 3)).alias("suffix"))
    return resolve_suffix(targets, f.select("path")).select("doc_id", "suffix", "path")


def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against every brand's most used type and words of events: contained, else within two edits."""
    symbols = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    queries = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("q")).distinct()
    queries = queries.unionByName(queries.select(F.concat("q", F.lit(" rinq")).alias("q"))).select(F.col("q").alias("query_id"), "q")
    return search.search(symbols, queries)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page with their number."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    return pages.groupBy("page_id", "dst").agg(F.count("*").alias("n"))


def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a few words stand alone in each document."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", *[T.keyword_count(F.coalesce("text", F.lit("")), w).alias(w) for w in ("the", "of", "die", "les")])


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and types as slugs."""
    return read(spark, sf_dir, "part").select("p_partkey", T.slugify(F.concat_ws(" -- ", "p_name", "p_type")).alias("slug"))


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert of later events over earlier ones: the newest value of each user and type."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return upsert(events.filter("value < 10"), events.filter("value >= 10"), ["user_id", "event_type"], F.col("event_id"))


def ignored_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers inserted unless an open order has them already."""
    new = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return insert_or_ignore(new, read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stay when the orders of one status go."""
    gone = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    left = without(read(spark, sf_dir, "lineitem"), gone, ["l_orderkey"])
    return left.groupBy("l_returnflag").agg(F.count("*").alias("n"))


def orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their number of orders, those without included."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


_F = "f AS (SELECT doc_id, text, n_chars, source || '/' || lang || '/' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'de' THEN '.py' WHEN 'fr' THEN '.json' ELSE '.cbl' END AS path FROM documents)"
ORACLES = {
    "manifest": f"WITH {_F} SELECT path AS rel_path, CASE WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.json' THEN 'json' ELSE 'cobol' END AS language, CASE WHEN path LIKE '%.md' THEN 'docs' WHEN path LIKE '%.json' THEN 'config' ELSE 'source' END AS category, CAST(strlen(text) AS BIGINT) AS size_bytes, sha1(text) AS checksum FROM f",
    "manifest_diff": f"WITH {_F}, n AS (SELECT path, md5(text) AS c FROM f WHERE path NOT LIKE 'src2/%'), b AS (SELECT path, md5(CASE WHEN n_chars > 5000 THEN upper(text) ELSE text END) AS c FROM f WHERE path NOT LIKE 'src1/%') SELECT coalesce(n.path, b.path) AS rel_path, CASE WHEN b.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN n.c = b.c THEN 'unchanged' ELSE 'changed' END AS change FROM n FULL JOIN b ON n.path = b.path",
    "path_tree": f"WITH {_F}, p AS (SELECT path, string_split(path, '/') AS l FROM f), x AS (SELECT path, array_to_string(list_slice(l, 1, i), '/') AS node FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM p)) SELECT node AS path, bool_or(node <> path) AS is_dir FROM x GROUP BY node",
    "suffix_resolution": f"WITH {_F}, t AS (SELECT doc_id, split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS suffix FROM f), x AS (SELECT split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS suffix, min(path) AS path FROM f GROUP BY 1) SELECT doc_id, suffix, path FROM t LEFT JOIN x USING (suffix)",
    "symbol_search": "WITH n AS (SELECT DISTINCT p_name AS name, lower(p_name) AS low FROM part), q0 AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS q FROM part), q AS (SELECT q FROM q0 UNION SELECT q || ' rinq' FROM q0), h AS (SELECT q AS query_id, name, CASE WHEN low = lower(q) THEN 0 WHEN starts_with(low, lower(q)) THEN 1 ELSE 2 END AS match_rank FROM n JOIN q ON contains(low, lower(q))), z AS (SELECT q AS query_id, name, 3 AS match_rank FROM n JOIN q ON levenshtein(lower(q), low) <= 2 WHERE q NOT IN (SELECT query_id FROM h)), a AS (SELECT * FROM h UNION ALL SELECT * FROM z) SELECT query_id, name, CAST(match_rank AS INTEGER) AS match_rank FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY match_rank, lower(name), name) <= 120",
    "page_links": "SELECT page_id, dst, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS dst FROM pages) GROUP BY ALL",
    "slugs": "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' -- ' || p_type), '[^\\w\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '-') AS slug FROM part",
    "latest_rows": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value >= 10 DESC, event_id DESC) = 1",
    "ignored_inserts": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "cascade_delete": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
    "orders_per_customer": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "keyword_counts": "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(regexp_replace(' ' || regexp_replace(coalesce(text, ''), '[^A-Za-z0-9_]', '  ', 'g') || ' ', '', ''), ' {w} ')) AS INTEGER) AS {w}" for w in ("the", "of", "die", "les")) + " FROM documents",
}

QUERIES = {f.__name__: f for f in (manifest, manifest_diff, path_tree, suffix_resolution, symbol_search, page_links, keyword_counts, slugs, latest_rows, ignored_inserts, cascade_delete, orders_per_customer)}
