"""Queries over several retrieval signals, with their SQL.

Files are documents, their category is the language, their community the source.  Symbols are the first words of
lines with their places in the text.  A line item calls from its order's document to its part's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions import text as T
from loomspark.operators import bm25, graph, ranking, signals
from loomspark.plans import retrieval
from loomspark.sources.tables import checkpoint, read

STEP = retrieval.CHUNK - 162


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, rel_path, category, community, text)"""
    return read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", "doc_id").alias("rel_path"), F.col("lang").alias("category"), F.col("source").alias("community"), "text")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, confidence): symbol edges between documents, one for each line item."""
    files = doc_files(spark, sf_dir).select("doc_id", "rel_path")
    n = files.count()
    lines = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % n).alias("a"), (F.col("l_partkey") % n).alias("b"), "l_suppkey", "l_linenumber", "l_discount")
    a, b = files.toDF("a", "src_file"), files.toDF("b", "dst_file")
    rows = lines.join(a, "a").join(b, "b")
    return rows.select(F.concat("src_file", F.lit("::s"), "l_suppkey").alias("src"), F.concat("dst_file", F.lit("::s"), "l_linenumber").alias("dst"), F.round(1 - F.col("l_discount"), 2).alias("confidence"))


def central_files(edges: DataFrame) -> DataFrame:
    """(rel_path, rank) of the 30 most central files."""
    files = edges.select(T.symbol_file(F.col("src")).alias("src"), T.symbol_file(F.col("dst")).alias("dst"))
    return graph.central(files).select(F.col("node").alias("rel_path"), "rank")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_path, name, fqn, line, start, end): the first word of every line that begins with one, and the line's place in the text."""
    lines = doc_files(spark, sf_dir).select("rel_path", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n", "\n"), "\n")).alias("line", "content"))
    before = F.coalesce(F.sum(F.char_length("content") + 1).over(W.partitionBy("rel_path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("start", before + 1).withColumn("name", F.regexp_extract(F.lower("content"), "^([A-Za-z0-9_]+)", 1)).filter("name <> ''")
    return placed.select("rel_path", "name", F.concat("rel_path", F.lit("::"), "name").alias("fqn"), "line", "start", (F.col("start") + F.char_length("content") - 1).alias("end"))


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, category): sections ask for English and French, or for German."""
    kinds = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("en"), F.lit("fr"))).otherwise(F.array(F.lit("de")))
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(kinds).alias("category"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four signals' ranks, and the stage-1 chunks behind them."""
    tops, i, _ = retrieval._tops(spark, sf_dir)
    stage1 = checkpoint(retrieval._best(tops, i, 100, "rel_path"))
    best = stage1.groupBy("query_id", "rel_path").agg(F.max("bm25").alias("score"))
    edges, files = checkpoint(call_edges(spark, sf_dir)), doc_files(spark, sf_dir).drop("text")
    return (
        ranking.ranked(best, "score", "rel_path", 100, "bm25")
        .unionByName(signals.graph_confidence(stage1, edges, central_files(edges)))
        .unionByName(signals.module_proximity(stage1.filter("rank <= 20"), files.select("rel_path", "community")))
        .unionByName(signals.category_hint(files, hints(spark, sf_dir)))
    )


def signal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 best files of each query by each of the four signals."""
    return _lists(spark, sf_dir).select("query_id", "signal", "rel_path", "rank", F.col("raw_score").cast("double").alias("raw_score"))


def four_signal_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best files of each query by the fusion of the four signals, with each signal's rank."""
    fused = ranking.rrf(_lists(spark, sf_dir).withColumnRenamed("rel_path", "item")).withColumn("rrf", F.round("rrf", 6))
    flat = fused.withColumn("signals", F.array_join(F.transform("ranks", lambda x: F.concat_ws("=", x["signal"], x["rank"])), ","))
    top = bm25.top_k(flat.withColumnRenamed("item", "chunk_id"), 10, "rrf")
    return top.select("query_id", "rank", F.col("chunk_id").alias("rel_path"), "rrf", "signals")


def final_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused ranks (0.6) with those of a second ranking (0.4), here by the number of query terms: ten files a query."""
    fused = ranking.rrf(_lists(spark, sf_dir).withColumnRenamed("rel_path", "item")).withColumn("rrf", F.round("rrf", 6))
    first = ranking.ranked(fused.withColumnRenamed("item", "rel_path"), "rrf", "rel_path", 100, "fused")
    hits = bm25.most_terms(retrieval.index(spark, sf_dir), retrieval.terms(spark, sf_dir), 100, "rel_path")
    second = ranking.ranked(hits, "score", "rel_path", 100, "second")
    both = ranking.rrf(first.unionByName(second).withColumnRenamed("rel_path", "item"), {"fused": 0.6, "second": 0.4}).withColumn("rrf", F.round("rrf", 6))
    return bm25.top_k(both.select("query_id", F.col("item").alias("chunk_id"), "rrf"), 10, "rrf").select("query_id", "rank", F.col("chunk_id").alias("rel_path"), "rrf")


def _ranges(chunks: DataFrame) -> DataFrame:
    """Chunks with the places of their first and last character."""
    start = F.col("chunk_index") * STEP + 1
    return chunks.withColumn("start", start.cast("long")).withColumn("end", (start + F.char_length("content") - 1).cast("long"))


def second_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second stage's scores of each query's 100 best chunks that reach the floor (or the five best of a query without any)."""
    tops, i, q = retrieval._tops(spark, sf_dir)
    top = checkpoint(_ranges(retrieval._best(tops, i, 100, "rel_path", "chunk_index", "content", "chunk_type", "lang", "source")).drop("content"))
    seeds = top.filter("rank <= 20")
    edges = call_edges(spark, sf_dir)
    yes = F.lit(True)
    defines = signals.defining_chunks(top, symbols(spark, sf_dir), q).withColumn("defines", yes)
    marked = top.join(defines, ["query_id", "chunk_id"], "left").join(hints(spark, sf_dir).withColumnRenamed("category", "lang").withColumn("hinted", yes), ["query_id", "lang"], "left")
    marked = marked.join(seeds.select("query_id", "rel_path").distinct().withColumn("seed", yes), ["query_id", "rel_path"], "left").join(seeds.select("query_id", "source").distinct().withColumn("module", yes), ["query_id", "source"], "left")
    marked = marked.join(F.broadcast(central_files(edges)).drop("rank").withColumn("central", yes), "rel_path", "left")  # 30 rows
    score = signals.chunk_score(F.col("bm25"), F.col("defines"), F.col("hinted"), F.col("seed"), F.col("module"), F.col("central"), F.col("chunk_type"))
    kept = signals.above_floor(marked.withColumn("score", F.round(score + 1e-8, 6)))  # of scores at six decimals, no product is a tie
    return kept.select("query_id", "chunk_id", "score", F.coalesce("defines", F.lit(False)).alias("defines"), F.coalesce("central", F.lit(False)).alias("central"))


def single_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best chunks of each query by the single-stage score, in both of its forms."""
    i, q = retrieval.index(spark, sf_dir), retrieval.terms(spark, sf_dir)
    # what a chunk can gain beside its BM25: a hinted category, the first of the central files, 1.8 and 0.9, and 0.6 for each term in its path
    scored = checkpoint(bm25.best(i, q, 20, weighted=False, slack=signals.CATEGORY_BONUS + signals.CENTRAL_BONUS + 1.8 + 0.9, path_slack=0.6))
    central = F.broadcast(central_files(call_edges(spark, sf_dir)).withColumnRenamed("rank", "central_rank"))  # 30 rows
    marked = i.chunks.select("chunk_id", "rel_path", "chunk_index", F.col("lang").alias("category")).join(scored, "chunk_id")
    asked = q.distinct().groupBy("query_id").agg(F.collect_list("term").alias("_terms"))
    held = F.size(F.filter("_terms", lambda t: F.contains(F.lower("rel_path"), t)))
    marked = marked.join(asked, "query_id").withColumn("path_terms", held).drop("_terms")
    marked = marked.join(hints(spark, sf_dir).withColumn("hinted", F.lit(True)), ["query_id", "category"], "left").join(central, "rel_path", "left")
    modes = []
    for mode, vectorless in (("vectorless", True), ("hybrid", False)):
        score = signals.single_stage_score(F.col("bm25"), F.col("hinted"), F.col("central_rank"), F.col("rel_path"), F.col("path_terms"), vectorless)
        modes.append(marked.select("query_id", "chunk_id", "rel_path", "chunk_index", F.lit(mode).alias("mode"), F.round(score, 6).alias("score")))
    own = W.partitionBy("query_id", "mode").orderBy(F.desc("score"), "rel_path", "chunk_index")
    top = modes[0].unionByName(modes[1]).withColumn("rank", F.row_number().over(own)).filter("rank <= 20")
    return top.select("query_id", "mode", "rank", "chunk_id", "score")


def lexical_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each query by plain hits of its terms, for a corpus without an index."""
    found = signals.best_chunk_hits(retrieval.chunks(spark, sf_dir), retrieval.terms(spark, sf_dir), 10, inside=False)
    return bm25.top_k(found, 10, "hits").select("query_id", "rank", "chunk_id", "hits")


def substring_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each query by occurrences of its terms anywhere in them."""
    found = signals.best_chunk_hits(retrieval.chunks(spark, sf_dir), retrieval.terms(spark, sf_dir), 10, inside=True)
    return bm25.top_k(found, 10, "hits").select("query_id", "rank", "chunk_id", "hits")


def best_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunk of each file that a query's 100 best chunks lie in: by score, else with a whole symbol, else the first."""
    tops, i, _ = retrieval._tops(spark, sf_dir)
    top = checkpoint(retrieval._best(tops, i, 100, "rel_path"))
    c = _ranges(i.chunks.select("chunk_id", "rel_path", "chunk_index", "content")).withColumnsRenamed({"start": "start_line", "end": "end_line"})
    s = symbols(spark, sf_dir).select("rel_path", F.col("start").alias("line_start"), F.col("end").alias("line_end"))
    # every second query's scores are withheld, so that the other two rules decide
    best = ranking.best_chunk_per_file(c, top.withColumn("bm25", F.when(F.col("query_id") % 2 == 0, F.col("bm25"))), s)
    return best.select("query_id", "rel_path", "chunk_id", F.coalesce("has_symbol", F.lit(0)).alias("has_symbol"))


def expansion_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files one call away from a query's ten best files that are not among its best 100 themselves, and the rerank target."""
    tops, i, _ = retrieval._tops(spark, sf_dir)
    top = checkpoint(retrieval._best(tops, i, 100, "rel_path").groupBy("query_id", "rel_path").agg(F.min("rank").alias("rank")))
    files = call_edges(spark, sf_dir).select(T.symbol_file(F.col("src")).alias("src"), T.symbol_file(F.col("dst")).alias("dst"))
    near = graph.undirected(files).withColumnRenamed("src", "rel_path")
    new = top.filter("rank <= 10").select("query_id", "rel_path").join(near, "rel_path").select("query_id", F.col("dst").alias("rel_path")).distinct().join(top.select("query_id", "rel_path"), ["query_id", "rel_path"], "left_anti")
    return new.groupBy("query_id").agg(F.count("*").alias("new_files"), F.min("rel_path").alias("first_file")).withColumn("rerank", signals.rerank_target(F.col("new_files")))


def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing parts of split documents of which at least half are among a query's 15 best chunks."""
    tops, i, _ = retrieval._tops(spark, sf_dir)
    n = F.count("*").over(W.partitionBy("rel_path", F.floor(F.col("chunk_index") / 3)))
    c = i.chunks.select("chunk_id", "rel_path", "chunk_index").withColumn("split_of", n).withColumn("split_part", F.col("chunk_index") % 3)
    return ranking.split_completion(tops.filter("rank <= 15"), c).select("query_id", "chunk_id", F.col("split_part").cast("int").alias("split_part"))


def function_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of symbols that call, or are called by, the first symbol of each query's five best chunks."""
    tops, i, _ = retrieval._tops(spark, sf_dir)
    seeds = checkpoint(tops.filter("rank <= 5").select("query_id", "chunk_id"))
    c = _ranges(i.chunks.select("chunk_id", "rel_path", "chunk_index", "content"))
    s = symbols(spark, sf_dir).select("fqn", "rel_path", "start", "end")
    following = s.withColumn("next", F.lead("fqn").over(W.partitionBy(F.substring("rel_path", 1, 5), F.substring_index("fqn", "::", -1)).orderBy("rel_path", "start")))
    edges = following.filter("next is not null and next <> fqn").select(F.col("fqn").alias("src"), F.col("next").alias("dst"), F.lit(0.9).alias("confidence"))
    return signals.function_neighbours(seeds, c, s, edges)


_BASE = retrieval._TOP.replace("rel_path, content, round(bm25, 6)", "rel_path, content, chunk_index, round(bm25, 6)") + """,
fl AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS rel_path, lang AS category, source AS community FROM documents),
nd AS (SELECT count(*) AS n FROM documents),
ce AS (SELECT a.rel_path || '::s' || l_suppkey AS src, b.rel_path || '::s' || l_linenumber AS dst, a.rel_path AS sf, b.rel_path AS df, round(1 - l_discount, 2) AS confidence FROM lineitem, nd JOIN fl a ON a.doc_id = l_orderkey % n JOIN fl b ON b.doc_id = l_partkey % n),
dg AS (SELECT node, sum(i) AS i, 3 * sum(i) + sum(o) AS s FROM (SELECT sf AS node, 0 AS i, 1 AS o FROM ce UNION ALL SELECT df, 1, 0 FROM ce) GROUP BY node),
ct AS (SELECT node AS rel_path, row_number() OVER (ORDER BY s DESC, i DESC, node) - 1 AS central_rank FROM dg QUALIFY row_number() OVER (ORDER BY s DESC, i DESC, node) <= 30),
hi AS (SELECT item_id AS query_id, unnest(CASE WHEN item_id % 2 = 0 THEN ['en', 'fr'] ELSE ['de'] END) AS category FROM benchmark)
"""
_SYMBOLS = """,
sl AS (SELECT rel_path, unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) AS content, generate_subscripts(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), 1) AS line FROM fl JOIN documents USING (doc_id)),
sp AS (SELECT rel_path, line, content, 1 + coalesce(sum(length(content) + 1) OVER (PARTITION BY rel_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sl),
sy AS (SELECT rel_path, regexp_extract(lower(content), '^([A-Za-z0-9_]+)', 1) AS name, s, s + length(content) - 1 AS e FROM sp WHERE regexp_extract(lower(content), '^([A-Za-z0-9_]+)', 1) <> '')
"""
_SIGNALS = _BASE + """,
s1 AS (SELECT query_id, rel_path, max(bm25) AS score, min(rank) AS rank FROM t WHERE rank <= 100 GROUP BY ALL),
g0 AS (SELECT query_id, df AS rel_path, confidence FROM (SELECT DISTINCT src, dst, sf, df, confidence FROM ce WHERE sf <> df) x JOIN s1 ON x.sf = s1.rel_path UNION ALL SELECT query_id, rel_path, 0 FROM s1),
g1 AS (SELECT g0.query_id, g0.rel_path, round(least(sum(confidence), 2.0) * CASE WHEN max(ct.rel_path) IS NOT NULL THEN 1.5 ELSE 1.0 END, 6) AS score FROM g0 LEFT JOIN ct ON ct.rel_path = g0.rel_path GROUP BY g0.query_id, g0.rel_path),
m1 AS (SELECT DISTINCT x.query_id, fl.rel_path, 1.3 AS score FROM (SELECT DISTINCT query_id, community FROM t JOIN fl USING (rel_path) WHERE rank <= 20) x JOIN fl USING (community)),
h1 AS (SELECT DISTINCT query_id, rel_path, 1.4 AS score FROM hi JOIN fl USING (category)),
al AS (SELECT query_id, rel_path, 'bm25' AS signal, CAST(score AS DOUBLE) AS raw_score FROM s1 UNION ALL SELECT query_id, rel_path, 'graph_confidence', CAST(score AS DOUBLE) FROM g1 UNION ALL SELECT query_id, rel_path, 'module_proximity', CAST(score AS DOUBLE) FROM m1 UNION ALL SELECT query_id, rel_path, 'category_hint', CAST(score AS DOUBLE) FROM h1),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, signal ORDER BY raw_score DESC, rel_path) AS INTEGER) AS rank FROM al QUALIFY row_number() OVER (PARTITION BY query_id, signal ORDER BY raw_score DESC, rel_path) <= 100),
fu AS (SELECT query_id, rel_path, round(sum(1.0 / (60 + rank)), 6) AS rrf, string_agg(signal || '=' || rank, ',' ORDER BY signal) AS signals FROM rk GROUP BY ALL)
"""
ORACLES = {
    "signal_ranks": f"WITH {_SIGNALS} SELECT query_id, signal, rel_path, rank, raw_score FROM rk",
    "four_signal_fusion": f"WITH {_SIGNALS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rel_path) AS INTEGER) AS rank, rel_path, rrf, signals FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rel_path) <= 10",
    "final_fusion": f"""WITH {_SIGNALS}, k1 AS (SELECT query_id, rel_path, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rel_path) AS rank FROM fu),
w2 AS (SELECT q.query_id, x.rel_path, count(*) AS score FROM q JOIN (SELECT DISTINCT c.rel_path, p.term FROM p JOIN c USING (chunk_id)) x USING (term) GROUP BY ALL),
k2 AS (SELECT query_id, rel_path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rel_path) AS rank FROM w2),
bo AS (SELECT query_id, rel_path, round(sum(w / (60 + rank)), 6) AS rrf FROM (SELECT *, 0.6 AS w FROM k1 WHERE rank <= 100 UNION ALL SELECT *, 0.4 FROM k2 WHERE rank <= 100) GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rel_path) AS INTEGER) AS rank, rel_path, rrf FROM bo QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rel_path) <= 10""",
    "second_stage": f"""WITH {_BASE}{_SYMBOLS}, tt AS (SELECT t.*, fl.category, fl.community, chunk_index * 1138 + 1 AS a, chunk_index * 1138 + length(content) AS z, CASE WHEN regexp_matches(content, '[0-9]{{3}}') THEN 1.5 ELSE 1.0 END AS w FROM t JOIN fl USING (rel_path) WHERE rank <= 100),
df AS (SELECT DISTINCT tt.query_id, tt.chunk_id FROM tt JOIN sy ON sy.rel_path = tt.rel_path AND sy.s >= tt.a AND sy.e <= tt.z JOIN q ON q.query_id = tt.query_id AND q.term = sy.name),
sd AS (SELECT DISTINCT query_id, rel_path, community FROM tt WHERE rank <= 20),
sc AS (SELECT tt.query_id, tt.chunk_id, df.chunk_id IS NOT NULL AS defines, ct.rel_path IS NOT NULL AS central,
  round(((bm25 + CASE WHEN df.chunk_id IS NOT NULL THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN hi.query_id IS NOT NULL THEN 1.4::DOUBLE ELSE 0 END) * (CASE WHEN tt.rel_path IN (SELECT rel_path FROM sd WHERE sd.query_id = tt.query_id) THEN 1.5::DOUBLE ELSE 1 END
  * CASE WHEN tt.community IN (SELECT community FROM sd WHERE sd.query_id = tt.query_id) THEN 1.3::DOUBLE ELSE 1 END) + CASE WHEN ct.rel_path IS NOT NULL THEN 2.6::DOUBLE ELSE 0 END) * w::DOUBLE + 1e-8, 6) AS score
  FROM tt LEFT JOIN df ON df.query_id = tt.query_id AND df.chunk_id = tt.chunk_id LEFT JOIN hi ON hi.query_id = tt.query_id AND hi.category = tt.category LEFT JOIN ct ON ct.rel_path = tt.rel_path)
SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, defines, central FROM sc WHERE score > 0 QUALIFY score >= 10 OR (max(score) OVER (PARTITION BY query_id) < 10 AND row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5)""",
    "single_stage": f"""WITH {_BASE}, ph AS (SELECT q.query_id, fl.rel_path, count(*) AS k FROM q JOIN fl ON contains(lower(fl.rel_path), q.term) GROUP BY ALL),
b0 AS (SELECT r.query_id, r.chunk_id, round(r.content_score + pb.bonus, 6) AS bm25, c.rel_path, c.chunk_index, c.lang FROM r JOIN pb USING (query_id, chunk_id) JOIN c USING (chunk_id)),
b1 AS (SELECT b0.*, central_rank, coalesce(ph.k, 0) AS k, bm25 + CASE WHEN hi.query_id IS NOT NULL THEN 1.4 ELSE 0 END + coalesce(greatest(0, 2.6 - 0.08 * central_rank), 0) AS base FROM b0 LEFT JOIN hi ON hi.query_id = b0.query_id AND hi.category = b0.lang LEFT JOIN ct ON ct.rel_path = b0.rel_path LEFT JOIN ph ON ph.query_id = b0.query_id AND ph.rel_path = b0.rel_path),
b2 AS (SELECT query_id, chunk_id, rel_path, chunk_index, 'vectorless' AS mode, round(base + CASE WHEN central_rank IS NOT NULL THEN 1.8 ELSE 0 END + CASE WHEN regexp_matches(lower(rel_path), 'index|router|service') THEN 0.9 ELSE 0 END, 6) AS score FROM b1 UNION ALL SELECT query_id, chunk_id, rel_path, chunk_index, 'hybrid', round(base + 0.6 * k, 6) FROM b1)
SELECT query_id, mode, CAST(row_number() OVER (PARTITION BY query_id, mode ORDER BY score DESC, rel_path, chunk_index) AS INTEGER) AS rank, chunk_id, CAST(score AS DOUBLE) AS score FROM b2 QUALIFY row_number() OVER (PARTITION BY query_id, mode ORDER BY score DESC, rel_path, chunk_index) <= 20""",
    "substring_fallback": f"""WITH {_BASE}, qt AS (SELECT DISTINCT term FROM q), held AS (SELECT chunk_id, term, (length(lower(content)) - length(replace(lower(content), term, ''))) // length(term) AS k FROM c JOIN qt ON contains(lower(content), term)),
lh AS (SELECT q.query_id, held.chunk_id, k AS hits FROM q JOIN held USING (term) UNION ALL SELECT q.query_id, c.chunk_id, 2 FROM q JOIN fl ON contains(lower(fl.rel_path), q.term) JOIN c ON c.rel_path = fl.rel_path),
ls AS (SELECT query_id, chunk_id, CAST(sum(hits) AS BIGINT) AS hits FROM lh GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS INTEGER) AS rank, chunk_id, hits FROM ls QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) <= 10""",
    "lexical_fallback": f"""WITH {_BASE}, lh AS (SELECT q.query_id, p.chunk_id, p.tf AS hits FROM q JOIN p USING (term) UNION ALL SELECT q.query_id, c.chunk_id, 2 FROM q JOIN fl ON contains(lower(fl.rel_path), q.term) JOIN c ON c.rel_path = fl.rel_path),
ls AS (SELECT query_id, chunk_id, CAST(sum(hits) AS BIGINT) AS hits FROM lh GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS INTEGER) AS rank, chunk_id, hits FROM ls QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) <= 10""",
    "best_chunks": f"""WITH {_BASE}{_SYMBOLS}, ff AS (SELECT DISTINCT query_id, rel_path FROM t WHERE rank <= 100),
hs AS (SELECT DISTINCT c.chunk_id FROM c JOIN sy ON sy.rel_path = c.rel_path AND sy.s >= c.chunk_index * 1138 + 1 AND sy.e <= c.chunk_index * 1138 + length(c.content)),
bb AS (SELECT ff.query_id, ff.rel_path, c.chunk_id, c.chunk_index, CASE WHEN ff.query_id % 2 = 0 THEN t.bm25 END AS bm25, CASE WHEN hs.chunk_id IS NULL THEN 0 ELSE 1 END AS has_symbol FROM ff JOIN c USING (rel_path) LEFT JOIN t ON t.query_id = ff.query_id AND t.chunk_id = c.chunk_id AND t.rank <= 100 LEFT JOIN hs ON hs.chunk_id = c.chunk_id)
SELECT query_id, rel_path, chunk_id, has_symbol FROM bb QUALIFY row_number() OVER (PARTITION BY query_id, rel_path ORDER BY bm25 DESC NULLS LAST, has_symbol DESC, chunk_index, chunk_id) = 1""",
    "expansion_files": f"""WITH {_BASE}, s1 AS (SELECT query_id, rel_path, min(rank) AS rank FROM t WHERE rank <= 100 GROUP BY ALL), un AS (SELECT DISTINCT sf, df FROM (SELECT sf, df FROM ce UNION ALL SELECT df, sf FROM ce) WHERE sf <> df),
ne AS (SELECT DISTINCT s1.query_id, un.df AS rel_path FROM s1 JOIN un ON un.sf = s1.rel_path WHERE s1.rank <= 10 AND NOT EXISTS (SELECT 1 FROM s1 o WHERE o.query_id = s1.query_id AND o.rel_path = un.df))
SELECT query_id, count(*) AS new_files, min(rel_path) AS first_file, CAST(least(count(*), greatest(100, round_even(0.75 * count(*), 0))) AS BIGINT) AS rerank FROM ne GROUP BY query_id""",
    "split_parts": f"""WITH {_BASE}, sq AS (SELECT chunk_id, rel_path, chunk_index - chunk_index % 3 AS base, CAST(chunk_index % 3 AS INTEGER) AS split_part, count(*) OVER (PARTITION BY rel_path, chunk_index // 3) AS split_of FROM c),
pp AS (SELECT * FROM sq WHERE split_of > 1), ha AS (SELECT t.query_id, pp.* FROM t JOIN pp USING (chunk_id) WHERE rank <= 15), gr AS (SELECT query_id, rel_path, base FROM ha GROUP BY query_id, rel_path, base, split_of HAVING count(*) < split_of AND count(*) >= 0.5 * split_of)
SELECT gr.query_id, pp.chunk_id, pp.split_part FROM gr JOIN pp USING (rel_path, base) WHERE NOT EXISTS (SELECT 1 FROM ha WHERE ha.query_id = gr.query_id AND ha.chunk_id = pp.chunk_id)""",
    "function_expansion": f"""WITH {_BASE}{_SYMBOLS}, sg AS (SELECT query_id, chunk_id FROM t WHERE rank <= 5), pl AS (SELECT c.chunk_id, sy.rel_path || '::' || sy.name AS fqn, sy.s FROM c JOIN sy ON sy.rel_path = c.rel_path AND sy.s >= c.chunk_index * 1138 + 1 AND sy.e <= c.chunk_index * 1138 + length(c.content)),
f1 AS (SELECT chunk_id, arg_min(fqn, (s, fqn)) AS fqn FROM pl GROUP BY chunk_id),
nx AS (SELECT rel_path || '::' || name AS src, lead(rel_path || '::' || name) OVER (PARTITION BY substr(rel_path, 1, 5), name ORDER BY rel_path, s) AS dst FROM sy),
bt AS (SELECT src AS fqn, dst AS other FROM nx WHERE dst <> src UNION SELECT dst, src FROM nx WHERE dst <> src),
fo AS (SELECT DISTINCT sg.query_id, bt.other FROM sg JOIN f1 USING (chunk_id) JOIN bt USING (fqn)), ho AS (SELECT fqn, min(chunk_id) AS chunk_id FROM pl GROUP BY fqn)
SELECT DISTINCT fo.query_id, ho.chunk_id FROM fo JOIN ho ON ho.fqn = fo.other WHERE NOT EXISTS (SELECT 1 FROM sg WHERE sg.query_id = fo.query_id AND sg.chunk_id = ho.chunk_id)""",
}

QUERIES = {f.__name__: f for f in (signal_ranks, four_signal_fusion, final_fusion, second_stage, single_stage, lexical_fallback, substring_fallback, best_chunks, expansion_files, split_parts, function_expansion)}
