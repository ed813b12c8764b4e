"""Operator 3, URL filters by a temporal list join (DataFrame functions only).

A list is a log of dated additions and removals of hosts.  Each addition becomes a validity interval that ends
at the entry's next removal; an as-of join holds every capture against the entries that were active when it
was fetched.  An entry covers its host and all hosts below it; the longest active entry decides.  Addresses (IPv4, also with
hexadecimal parts, and IPv6 in brackets) have no parents: only an entry of the whole address covers one.

Captures are exploded into their host and its parents and joined on (entry, salt): the salt deals a host
that has a third of all captures to many tasks, and the intervals, which are as many as the list has entries,
are repeated for each salt.

Defined results: a url that is null or has no host matches nothing; hosts and entries are compared in lower case and without dots
at their end (example.com. is example.com); a capture without a time is not held
against any entry; several additions in a row count from the first; a removal takes effect at its date; of
additions and removals at one date the removal comes last; repeated captures (same id, url and time) are one
row; an empty table gives an empty result; extra columns are ignored.

``pages`` has neither times nor a list, so the query derives both from the table (see ``op3_url_filters``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.llm import common

SALTS = 32
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
#: A host that is an address: in brackets, or with a number as its last label.
ADDRESS = r"^\[|(^|\.)([0-9]+|0x[0-9a-f]*)$"
#: Days from the first date of the query's captures and list entries.
FIRST, DAYS = "2024-01-01", 730


def host_of(url: Column) -> Column:
    """The lower-case host of a url without dots at its end, null where there is none; an IPv6 address keeps its brackets."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parents, down to two labels (a host of one label, or an address: itself)."""
    labels = F.split(host, r"\.")
    last = F.when(F.rlike(host, F.lit(ADDRESS)), 1).otherwise(F.greatest(F.lit(1), F.size(labels) - 1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(events: DataFrame) -> DataFrame:
    """(entry, listed_on, until) from (entry, action, on): active from listed_on, before until (null: still)."""
    own = W.partitionBy("entry").orderBy("on", "action")
    named = events.select(F.nullif(F.rtrim(F.lower("entry"), F.lit(".")), F.lit("")).alias("entry"), "action", "on")
    steps = named.filter("entry is not null and on is not null and action in ('add', 'remove')").distinct()
    steps = steps.withColumn("before", F.lag("action").over(own)).filter("before is null or before <> action")
    return steps.withColumn("until", F.lead("on").over(own)).filter("action = 'add' and (until is null or until > on)").select("entry", F.col("on").alias("listed_on"), "until")


def evaluate(captures: DataFrame, events: DataFrame, salts: int = SALTS) -> DataFrame:
    """(page_id, url, fetched_on, host, blocked, entry, listed_on) for each capture (page_id, url, fetched_on)."""
    rows = captures.select("page_id", "url", "fetched_on").withColumn("host", host_of(F.col("url")))
    tried = rows.filter("host is not null and fetched_on is not null").select("page_id", "url", "fetched_on", "host", F.explode(suffixes(F.col("host"))).alias("entry"))
    tried = tried.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched_on"), F.lit(salts)).cast("int"))
    active = intervals(events).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = tried.join(active, ["entry", "salt"]).filter("fetched_on >= listed_on and (until is null or fetched_on < until)")
    hits = hits.select("page_id", "url", "fetched_on", "host", F.struct(F.char_length("entry").alias("n"), F.col("entry").alias("entry"), F.col("listed_on").alias("listed_on")).alias("hit"))
    every = rows.select("page_id", "url", "fetched_on", "host", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"))
    best = hits.unionByName(every).groupBy("page_id", "url", "fetched_on", "host").agg(F.max("hit").alias("hit"))
    return best.select("page_id", "url", "fetched_on", "host", F.col("hit").isNotNull().alias("blocked"), F.col("hit.entry").alias("entry"), F.col("hit.listed_on").alias("listed_on"))


def _number(x: Column, at: int) -> Column:
    """A number below 65,536 from four hex digits of a name's digest."""
    return F.conv(F.substring(F.md5(x), at, 4), 16, 10).cast("int")


def list_events(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages and their parents: about a fifth is listed, some of it removed, some of that listed again."""
    names = pages.select(F.explode(suffixes(host_of(F.col("url")))).alias("entry")).distinct()
    names = names.filter(_number(F.col("entry"), 1) % 5 == 0).withColumn("start", _number(F.col("entry"), 5) % DAYS)
    names = names.withColumn("gap", _number(F.col("entry"), 9) % 200 + 1).withColumn("kind", _number(F.col("entry"), 13) % 3)
    day = lambda n: F.date_add(F.lit(FIRST).cast("date"), n)
    added = names.select("entry", F.lit("add").alias("action"), day(F.col("start")).alias("on"))
    removed = names.filter("kind >= 1").select("entry", F.lit("remove").alias("action"), day(F.col("start") + F.col("gap")).alias("on"))
    again = names.filter("kind = 2").select("entry", F.lit("add").alias("action"), day(F.col("start") + 2 * F.col("gap")).alias("on"))
    return added.union(removed).union(again)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day that its id gives, against a list derived from all pages' hosts."""
    pages = common.read(spark, sf_dir, "pages")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit(FIRST).cast("date"), (F.col("page_id") * 37 % DAYS).cast("int")))
    return evaluate(captures, list_events(pages)).drop("url")


ORACLE = r"""
WITH c AS (
  SELECT DISTINCT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 730 AS INTEGER) AS DATE) AS fetched_on,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '.'), '') AS host
  FROM pages
), h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM c WHERE host IS NOT NULL),
s AS (SELECT host, array_to_string(list_slice(l, i, len(l)), '.') AS entry FROM (SELECT host, l, unnest(range(1, CASE WHEN regexp_matches(host, '^\[|(^|\.)([0-9]+|0x[0-9a-f]*)$') THEN 2 ELSE greatest(2, len(l)) END)) AS i FROM h)),
n AS (
  SELECT entry, CAST('0x' || substr(m, 5, 4) AS INTEGER) % 730 AS start, CAST('0x' || substr(m, 9, 4) AS INTEGER) % 200 + 1 AS gap, CAST('0x' || substr(m, 13, 4) AS INTEGER) % 3 AS kind
  FROM (SELECT DISTINCT entry, md5(entry) AS m FROM s) WHERE CAST('0x' || substr(m, 1, 4) AS INTEGER) % 5 = 0
), v AS (
  SELECT entry, DATE '2024-01-01' + start AS listed_on, CASE WHEN kind >= 1 THEN DATE '2024-01-01' + (start + gap) END AS until FROM n
  UNION ALL SELECT entry, DATE '2024-01-01' + (start + 2 * gap), NULL FROM n WHERE kind = 2
), m AS (
  SELECT c.page_id, c.url, c.fetched_on, v.entry, v.listed_on,
    row_number() OVER (PARTITION BY c.page_id, c.url, c.fetched_on ORDER BY length(v.entry) DESC, v.entry DESC, v.listed_on DESC) AS r
  FROM c JOIN s ON c.host = s.host JOIN v ON v.entry = s.entry AND c.fetched_on >= v.listed_on AND (v.until IS NULL OR c.fetched_on < v.until)
)
SELECT c.page_id, c.fetched_on, c.host, m.entry IS NOT NULL AS blocked, m.entry, CAST(m.listed_on AS DATE) AS listed_on
FROM c LEFT JOIN m ON m.r = 1 AND c.page_id = m.page_id AND c.url = m.url AND c.fetched_on = m.fetched_on
"""

QUERIES = {"op3_url_filters": op3_url_filters}
ORACLES = {"op3_url_filters": ORACLE}
