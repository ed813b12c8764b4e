"""Retrieval queries over documents (chunks) and benchmark (queries), with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import bm25, ranking
from loomspark.sources.tables import checkpoint, read, shared_folder, version

CHUNK = 1300


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all documents as chunks of files source/lang/doc_id."""
    docs = read(spark, sf_dir, "documents").withColumn("rel_path", F.concat_ws("/", "source", "lang", "doc_id"))
    cut = T.flat_chunks(docs, "text", F.lit(CHUNK))
    kind = F.when(F.rlike("content", F.lit(r"[0-9]{3}")), "function").otherwise("block")
    return cut.select((F.col("doc_id") * 100000 + F.col("chunk_index")).alias("chunk_id"), "doc_id", "rel_path", "lang", "source", "chunk_index", "content", kind.alias("chunk_type"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, term) of every benchmark text."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.query_terms(F.col("text"))).alias("term"))


_CHUNKS = r"""
d AS (SELECT doc_id, lang, source, source || '/' || lang || '/' || doc_id AS rel_path, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS t FROM documents),
n AS (SELECT *, CASE WHEN length(t) <= 1300 THEN 1 ELSE CAST(ceil((length(t) - 1300) / 1138.0) AS BIGINT) + 1 END AS k FROM d),
c0 AS (SELECT *, unnest(range(0, k)) AS chunk_index FROM n),
c AS (SELECT doc_id * 100000 + chunk_index AS chunk_id, doc_id, rel_path, lang, source, chunk_index, substr(t, CAST(chunk_index * 1138 + 1 AS BIGINT), 1300) AS content FROM c0),
w AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[A-Za-z0-9_]+')) AS term FROM c),
p AS (SELECT chunk_id, term, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT chunk_id, len(regexp_extract_all(lower(content), '[A-Za-z0-9_]+')) AS dl FROM c),
g AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
s AS (SELECT term, count(*) AS df, ln((max(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM p, g GROUP BY term HAVING count(*) >= 2),
q0 AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS term FROM benchmark),
q1 AS (SELECT query_id, term FROM q0 WHERE length(term) > 1 UNION SELECT query_id, x FROM (SELECT query_id, unnest(string_split(term, '_')) AS x FROM q0 WHERE length(term) > 1 AND contains(term, '_')) WHERE length(x) > 1),
q AS (SELECT DISTINCT query_id, term FROM q1),
r AS (
  SELECT q.query_id, p.chunk_id, sum(s.idf * p.tf * 3.0 / (p.tf + 2.0 * (0.25 + 0.75 * l.dl / g.avgdl))) AS content_score
  FROM q JOIN s USING (term) JOIN p USING (term) JOIN l USING (chunk_id), g GROUP BY q.query_id, p.chunk_id
),
pb AS (SELECT r.query_id, r.chunk_id, sum(CASE WHEN contains(lower(c.rel_path), q.term) THEN s.idf ELSE 0 END) AS bonus FROM r JOIN c USING (chunk_id) JOIN q USING (query_id) JOIN s USING (term) GROUP BY ALL),
b AS (
  SELECT r.query_id, r.chunk_id, c.rel_path, c.content, c.chunk_index, (r.content_score + pb.bonus) * CASE WHEN regexp_matches(c.content, '[0-9]{3}') THEN 1.5 ELSE 1.0 END AS bm25
  FROM r JOIN pb USING (query_id, chunk_id) JOIN c USING (chunk_id)
)
"""


_INDEXES: dict[tuple[str, str, str], bm25.Index] = {}


def index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The index of all chunks: written once for each state of the documents, then read by every query of the session."""
    state = (spark.sparkContext.applicationId, sf_dir, version(read(spark, sf_dir, "documents")))
    if state not in _INDEXES:
        _INDEXES[state] = bm25.write_index(chunks(spark, sf_dir), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return _INDEXES[state]


#: No query looks further down the ranking of its chunks.
TOP = 100
_TOPS: dict[tuple[str, str, str, str], DataFrame] = {}


def _tops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bm25.Index, DataFrame]:
    """The 100 best chunks of each query with their rank, by scores at six decimals, so that sums of another order rank alike; the index; the query terms.

    They are a table like the index: written once for each state of documents and benchmark.
    """
    i, q = index(spark, sf_dir), terms(spark, sf_dir)
    state = (spark.sparkContext.applicationId, sf_dir, version(read(spark, sf_dir, "documents")), version(read(spark, sf_dir, "benchmark")))
    if state not in _TOPS:
        _TOPS[state] = checkpoint(bm25.top_k(bm25.best(i, q, TOP), TOP))
    return _TOPS[state], i, q


def _best(tops: DataFrame, i: bm25.Index, k: int, *columns: str) -> DataFrame:
    """The k best chunks of each query with more of their columns."""
    return i.chunks.select("chunk_id", *columns).join(bm25.small(tops.filter(F.col("rank") <= k)), "chunk_id")


def _six(name: str):
    return F.round(name, 6).alias(name)


def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of every benchmark text."""
    tops, i, _ = _tops(spark, sf_dir)
    return _best(tops, i, 10, "rel_path").select("query_id", "rank", "chunk_id", "rel_path", "bm25")


_TOP = _CHUNKS + ", t AS (SELECT query_id, chunk_id, rel_path, content, round(bm25, 6) AS bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, chunk_id) AS INTEGER) AS rank FROM b)"


def bm25_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks within four fifths of each query's best score."""
    found = bm25.best(index(spark, sf_dir), terms(spark, sf_dir), 1, share=0.8)
    return bm25.cut_off(found, 1.0, 0.8).select("query_id", "chunk_id", "bm25")


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and weight of every term of two chunks or more."""
    return index(spark, sf_dir).stats.select("term", "df", _six("idf"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's key, size, token estimate and content hash."""
    c = chunks(spark, sf_dir)
    return c.select("chunk_id", "rel_path", F.char_length("content").alias("n_chars"), T.token_estimate(F.col("content")).alias("token_estimate"), F.md5("content").alias("content_md5"), "chunk_type")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 per file fused with the number of query terms that a file holds: the ten best files of each query."""
    i, q = index(spark, sf_dir), terms(spark, sf_dir)
    best = bm25.best(i, q, 100, "rel_path").withColumnRenamed("bm25", "score")
    hits = bm25.most_terms(i, q, 100, "rel_path")
    lists = ranking.ranked(best, "score", "rel_path", 100, "bm25").unionByName(ranking.ranked(hits, "score", "rel_path", 100, "terms"))
    fused = ranking.rrf(lists.withColumnRenamed("rel_path", "item")).withColumn("rrf", F.round("rrf", 6))
    flat = fused.withColumn("signals", F.array_join(F.transform("ranks", lambda x: F.concat_ws("=", x["signal"], x["rank"])), ","))
    return bm25.top_k(flat.withColumnRenamed("item", "chunk_id"), 10, "rrf").select("query_id", "rank", F.col("chunk_id").alias("rel_path"), "rrf", "signals")


_RRF = _CHUNKS + """,
f1 AS (SELECT query_id, rel_path, max(round(bm25, 6)) AS score FROM b GROUP BY ALL),
f2 AS (SELECT q.query_id, x.rel_path, count(*) AS score FROM q JOIN (SELECT DISTINCT c.rel_path, p.term FROM p JOIN c USING (chunk_id)) x USING (term) GROUP BY ALL),
k AS (
  SELECT query_id, rel_path, 'bm25' AS signal, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rel_path) AS rank FROM f1
  UNION ALL SELECT query_id, rel_path, 'terms', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rel_path) FROM f2
),
z AS (SELECT query_id, rel_path, round(sum(1.0 / (60 + rank)), 6) AS rrf, string_agg(signal || '=' || rank, ',' ORDER BY signal) AS signals FROM k WHERE rank <= 100 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rel_path) AS INTEGER) AS rank, rel_path, rrf, signals
FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rel_path) <= 10
"""


def budget_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 best chunks of each query under a budget of 7,000 tokens; what would overflow is skipped."""
    tops, i, _ = _tops(spark, sf_dir)
    rows = _best(tops, i, 100, "content").select("query_id", "rank", "chunk_id", T.token_estimate(F.col("content")).cast("long").alias("tokens"))
    return ranking.budget(rows, 7000, [F.col("rank")])


_BUDGET = _TOP + """,
x AS (SELECT t.query_id, t.rank, t.chunk_id, CAST(greatest(1, length(t.content) // 4) AS BIGINT) AS tokens FROM t WHERE rank <= 100),
f(query_id, rank, chunk_id, tokens, used, kept) AS (
  SELECT DISTINCT query_id, 0, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), false FROM x
  UNION ALL SELECT f.query_id, x.rank, x.chunk_id, x.tokens, CASE WHEN f.used + x.tokens <= 7000 THEN f.used + x.tokens ELSE f.used END, f.used + x.tokens <= 7000 FROM f JOIN x ON f.query_id = x.query_id AND x.rank = f.rank + 1
)
SELECT query_id, rank, chunk_id, tokens FROM f WHERE kept
"""


def capped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 best chunks of each query, no more of a file than its cap allows."""
    tops, i, _ = _tops(spark, sf_dir)
    top, c = _best(tops, i, 100, "rel_path").select("query_id", "rank", "chunk_id", "rel_path"), i.chunks
    sizes = c.groupBy("rel_path").agg(F.count("*").alias("n"), F.sum(F.char_length("content")).alias("size"), F.count_if(F.col("chunk_type") == "function").alias("symbols"))
    total = c.agg(F.count("*").alias("total"))
    caps = sizes.join(F.broadcast(total)).select("rel_path", ranking.file_cap(F.col("n"), F.col("total"), F.lit(False), F.col("symbols"), F.col("size")).alias("cap"))
    return ranking.cap_per_file(top, caps, [F.col("rank")]).select("query_id", "rank", "chunk_id")


_CAPPED = _TOP + """,
z AS (SELECT rel_path, count(*) AS n, sum(length(content)) AS size, count(*) FILTER (regexp_matches(content, '[0-9]{3}')) AS symbols FROM c GROUP BY rel_path),
cap AS (SELECT rel_path, greatest(2, least(8, CAST(round_even(2 + log2(n + 1) + CASE WHEN n >= 0.3 * (SELECT count(*) FROM c) AND (SELECT count(*) FROM c) >= 20 THEN 1 ELSE 0 END
  + CASE WHEN symbols >= 10 THEN 1 ELSE 0 END + CASE WHEN size >= 8000 AND symbols >= 5 THEN 1 WHEN size >= 8000 AND symbols <= 2 THEN -1 ELSE 0 END, 0) AS INTEGER))) AS cap FROM z),
y AS (SELECT query_id, rank, chunk_id, rel_path, row_number() OVER (PARTITION BY query_id, rel_path ORDER BY rank) AS i FROM t WHERE rank <= 100)
SELECT query_id, rank, chunk_id FROM y JOIN cap USING (rel_path) WHERE i <= cap
"""


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, path entropy and the quality label of each query's ten best chunks."""
    tops, i, q = _tops(spark, sf_dir)
    top = checkpoint(_best(tops, i, 10, "rel_path", "content", "chunk_type"))
    parts = ranking.coverage(q, top).join(ranking.path_entropy(top), "query_id")
    tops = top.groupBy("query_id").agg(F.max("bm25").alias("best"), F.bool_or(ranking.has_definition(F.col("chunk_type"), F.col("content"))).alias("has_definition"))
    made = parts.join(tops, "query_id").withColumn("q", ranking.quality_label(F.round("coverage", 6), F.round("path_entropy", 6), F.col("has_definition"), F.col("best")))
    return made.select("query_id", _six("coverage"), _six("path_entropy"), "has_definition", F.array_join("q.flags", ",").alias("flags"), F.col("q.label").alias("label"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_QUALITY = _TOP + f""",
u AS (SELECT * FROM t WHERE rank <= 10),
e0 AS (SELECT query_id, split_part(rel_path, '/', 1) AS d, count(*) AS k FROM u GROUP BY ALL),
e AS (SELECT query_id, round(-sum(k / n * log2(k / n)), 6) AS path_entropy FROM (SELECT *, sum(k) OVER (PARTITION BY query_id) AS n FROM e0) GROUP BY query_id),
told AS (SELECT * FROM q WHERE length(term) > 1 AND term NOT IN ({_STOP})),
h AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term FROM u),
v AS (SELECT told.query_id, round(count(h.term) / count(*), 6) AS coverage FROM told LEFT JOIN h ON told.query_id = h.query_id AND told.term = h.term GROUP BY told.query_id),
o AS (SELECT query_id, max(bm25) AS best, bool_or(regexp_matches(content, '[0-9]{{3}}') OR regexp_matches(content, '\\b(def |class |function )\\w')) AS has_definition FROM u GROUP BY query_id),
m AS (SELECT *, list_filter([CASE WHEN coverage < 0.5 THEN 'low_coverage' END, CASE WHEN path_entropy < 0.5 THEN 'mono_dir' END, CASE WHEN NOT has_definition THEN 'no_def' END, CASE WHEN best <= 10 THEN 'flat_score' END], lambda x: x IS NOT NULL) AS f FROM v JOIN e USING (query_id) JOIN o USING (query_id))
SELECT query_id, coverage, path_entropy, has_definition, array_to_string(f, ',') AS flags, CASE WHEN len(f) >= 2 OR path_entropy < 0.5 THEN 'weak' WHEN len(f) = 1 THEN 'mixed' ELSE 'strong' END AS label FROM m
"""


def boundary_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that do not end a sentence, extended by the file's next chunk."""
    c = chunks(spark, sf_dir)
    out = ranking.expand_to_next(c, ~F.rlike("content", F.lit(r"[.!?]\s*\z")))
    return out.select("chunk_id", "expanded", F.char_length("content").alias("n_chars"))


_EXPAND = _CHUNKS + r""",
x AS (SELECT chunk_id, content, lead(content) OVER (PARTITION BY rel_path ORDER BY chunk_index) AS nx, NOT regexp_matches(content, '[.!?]\s*\z') AS open FROM c)
SELECT chunk_id, open AND nx IS NOT NULL AND nx <> '' AS expanded, CASE WHEN open AND nx IS NOT NULL AND nx <> '' THEN length(content) + 1 + length(nx) ELSE length(content) END AS n_chars FROM x
"""


def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision at 5, hit rate and tokens of BM25 against plain term hits; relevant is a chunk that holds half the terms."""
    tops, i, q = _tops(spark, sf_dir)
    n, c = q.groupBy("query_id").agg(F.count("*").alias("n")), i.chunks
    a = tops.filter("rank <= 10").select("query_id", "chunk_id", "rank", F.lit("bm25").alias("mode"))
    b = bm25.top_k(bm25.most_terms(i, q, 10), 10, "score").select("query_id", "chunk_id", "rank", F.lit("hits").alias("mode"))
    both = bm25.small(a.unionByName(b))
    held = i.rows.join(bm25.small(both.select("chunk_id").distinct()), "chunk_id").select("chunk_id", F.explode("terms").alias("term"))
    hit = held.join(bm25.small(q.distinct()), "term").join(both.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("hits"))
    rows = both.join(hit, ["query_id", "chunk_id"]).join(n, "query_id").join(c.select("chunk_id", T.token_estimate(F.col("content")).cast("long").alias("tokens")), "chunk_id")
    out = ranking.mode_metrics(rows.withColumn("relevant", F.col("hits") * 2 >= F.col("n")))
    return out.select("mode", _six("precision_at_5"), _six("hit_rate"), "tokens")


_MODES = _TOP + """,
h AS (SELECT q.query_id, p.chunk_id, count(*) AS hits FROM q JOIN p USING (term) GROUP BY ALL),
nn AS (SELECT query_id, count(*) AS n FROM q GROUP BY ALL),
m AS (SELECT query_id, chunk_id, rank, 'bm25' AS mode FROM t WHERE rank <= 10
  UNION ALL (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank, 'hits' FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) <= 10)),
y AS (SELECT m.mode, m.query_id, sum(CASE WHEN m.rank <= 5 AND h.hits * 2 >= nn.n THEN 1 ELSE 0 END) / 5.0 AS p5, max(CASE WHEN h.hits * 2 >= nn.n THEN 1 ELSE 0 END) AS hit, sum(greatest(1, length(c.content) // 4)) AS tokens
  FROM m JOIN h USING (query_id, chunk_id) JOIN nn USING (query_id) JOIN c USING (chunk_id) GROUP BY ALL)
SELECT mode, round(avg(p5), 6) AS precision_at_5, round(avg(hit), 6) AS hit_rate, CAST(sum(tokens) AS BIGINT) AS tokens FROM y GROUP BY mode
"""

QUERIES = {f.__name__: f for f in (bm25_top10, bm25_cutoff, term_statistics, chunk_table, rrf_fusion, budget_packing, capped_files, retrieval_quality, boundary_expansion, mode_comparison)}
ORACLES = {
    "bm25_top10": f"WITH {_TOP} SELECT query_id, rank, chunk_id, rel_path, bm25 FROM t WHERE rank <= 10",
    "bm25_cutoff": f"WITH {_CHUNKS} SELECT query_id, chunk_id, round(bm25, 6) AS bm25 FROM b QUALIFY round(bm25, 6) >= greatest(1.0, 0.8 * max(round(bm25, 6)) OVER (PARTITION BY query_id))",
    "term_statistics": f"WITH {_CHUNKS} SELECT term, df, round(idf, 6) AS idf FROM s",
    "chunk_table": f"WITH {_CHUNKS} SELECT chunk_id, rel_path, CAST(length(content) AS INTEGER) AS n_chars, CAST(greatest(1, length(content) // 4) AS INTEGER) AS token_estimate, md5(content) AS content_md5, CASE WHEN regexp_matches(content, '[0-9]{{3}}') THEN 'function' ELSE 'block' END AS chunk_type FROM c",
    "rrf_fusion": f"WITH {_RRF}",
    "budget_packing": f"WITH RECURSIVE {_BUDGET}",
    "capped_files": f"WITH {_CAPPED}",
    "retrieval_quality": f"WITH {_QUALITY}",
    "boundary_expansion": f"WITH {_EXPAND}",
    "mode_comparison": f"WITH {_MODES}",
}
