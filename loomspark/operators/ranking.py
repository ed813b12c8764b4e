"""Signals, rank fusion, budgets, diversity and quality of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions import text as T
from loomspark.operators.ranges import contained
from loomspark.sources.tables import checkpoint

RRF_K = 61


def best_chunk_per_file(chunks: DataFrame, scored: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(query_id, rel_path, chunk_id): the file's best-scored chunk, else one that a symbol lies in, else its first."""
    inside = None
    if symbols is not None:
        placed = chunks.filter("start_line <> 0 or end_line <> 0").select("rel_path", "chunk_id", "start_line", "end_line")
        found = contained(placed, symbols.select("rel_path", "line_start", "line_end"), ["rel_path"], ("start_line", "end_line"), ("line_start", "line_end"))
        inside = found.select("chunk_id").distinct().withColumn("has_symbol", F.lit(1))
    # only files that the query reached at all
    files = scored.join(chunks.select("chunk_id", "rel_path"), "chunk_id").select("query_id", F.col("rel_path")).distinct() if "rel_path" not in scored.columns else scored.select("query_id", "rel_path").distinct()
    rows = files.join(chunks.select("rel_path", "chunk_id", "chunk_index"), "rel_path")
    rows = rows.join(scored.select("query_id", "chunk_id", "bm25"), ["query_id", "chunk_id"], "left")
    rows = rows.join(inside, "chunk_id", "left") if inside is not None else rows.withColumn("has_symbol", F.lit(None).cast("int"))
    own = W.partitionBy("query_id", "rel_path").orderBy(F.desc_nulls_last("bm25"), F.desc_nulls_last("has_symbol"), "chunk_index", "chunk_id")
    return rows.withColumn("r", F.row_number().over(own)).filter("r = 1").drop("r")


def ranked(scored: DataFrame, by: str, tie: str, k: int, signal: str) -> DataFrame:
    """(query_id, rel_path, rank, raw_score, signal) of the k best files of each query."""
    own = W.partitionBy("query_id").orderBy(F.desc(by), tie)
    return scored.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rel_path", "rank", F.col(by).alias("raw_score"), F.lit(signal).alias("signal"))


def rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, item, rank, signal): the weighted sum of 1 / (k - 1 + rank), and each signal's rank."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("signal") == name, w).otherwise(weight)
    one = lists.groupBy("query_id", "item", "signal").agg(F.min("rank").alias("rank"))
    return one.groupBy("query_id", "item").agg(F.sum(weight / (k - 1 + F.col("rank"))).alias("rrf"), F.sort_array(F.collect_list(F.struct("signal", "rank"))).alias("ranks"))


#: Places of a budget's ranking that one row of the fold covers.
FOLD_ROWS = 4096


def budget(ranked_rows: DataFrame, limit: int, order: list[Column], tokens: str = "tokens", group: str = "query_id") -> DataFrame:
    """Greedy packing: in order, take each item that still fits and skip one that does not.

    The rule depends on every decision before, so it is folded over the ranking: items in stretches of FOLD_ROWS, a
    round for each stretch over all groups at once.  A group is done when not even its smallest item left would fit, so that
    rounds follow the budget and not the length of the ranking; no item is cut off.
    """
    own = W.partitionBy(group).orderBy(*order)
    rest = W.partitionBy(group).orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = ranked_rows.withColumn("_r", F.row_number().over(own)).withColumn("_s", F.floor((F.col("_r") - 1) / FOLD_ROWS)).withColumn("_least", F.min(tokens).over(rest))
    placed = checkpoint(placed)
    start = lambda used: F.struct(used.cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def take(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x[tokens] <= limit
        return F.struct((acc["used"] + F.when(fits, x[tokens]).otherwise(0)).cast("long").alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["_r"]))).otherwise(acc["kept"]).alias("kept"))

    kept, stretch = None, 0
    state = placed.select(group).distinct().withColumn("used", F.lit(0).cast("long"))
    while True:
        here = placed.filter(F.col("_s") == stretch).join(state, group)
        lists = here.groupBy(group).agg(F.first("used").alias("used"), F.min("_least").alias("_least"), F.sort_array(F.collect_list(F.struct("_r", tokens))).alias("items"))
        folded = checkpoint(lists.filter(F.col("used") + F.col("_least") <= limit).select(group, F.aggregate("items", start(F.col("used")), take).alias("acc")))
        if folded.isEmpty():
            break
        some = folded.select(group, F.explode("acc.kept").alias("_r"))
        kept = some if kept is None else kept.unionByName(some)
        state, stretch = folded.select(group, "acc.used"), stretch + 1
    if kept is None:
        return placed.limit(0).drop("_r", "_s", "_least")
    return placed.join(kept, [group, "_r"], "left_semi").drop("_r", "_s", "_least")


def file_cap(n_chunks: Column, total: Column, central: Column, symbols: Column, size: Column) -> Column:
    """How many chunks of a file may be kept, from 2 to 8."""
    raw = (
        2 + F.log2(n_chunks + 1) + F.when(central, 2).otherwise(0) + F.when((total >= 20) & (n_chunks / total >= 0.3), 1).otherwise(0) + F.when(symbols >= 10, 1).otherwise(0)
        + F.when((size >= 8000) & (symbols >= 5), 1).when((size >= 8000) & (symbols <= 2), -1).otherwise(0)
    )
    return F.greatest(F.lit(2), F.least(F.lit(8), F.bround(raw, 0).cast("int")))


def cap_per_file(rows: DataFrame, caps: DataFrame, order: list[Column]) -> DataFrame:
    """Rows up to their file's cap, in order."""
    own = W.partitionBy("query_id", "rel_path").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(own)).join(caps, "rel_path").filter(F.col("_n") <= F.col("cap")).drop("_n", "cap")


def diversity(rows: DataFrame, order: list[Column], penalty: float = 0.1, tokens: str | None = None) -> DataFrame:
    """The soft relevance-diversity rule: the first five stay, later ones while their penalised score is positive; up to three stay whole.

    rows (query_id, score, ...) are a query's candidates, some hundred at most.  With `tokens` (a column of token arrays) a later row with
    score s stays if (1 - penalty) s - penalty m s > 0, where m is its highest Jaccard similarity to the rows kept before
    it: the decisions are folded over a query's candidates.  Up to a penalty of a half every positive score stays.
    """
    own = W.partitionBy("query_id")
    n = rows.withColumn("_r", F.row_number().over(own.orderBy(*order))).withColumn("_n", F.count("*").over(own))
    if tokens is None or penalty <= 0.5:
        return n.filter("_n <= 3 or _r <= 5 or score > 0").drop("_r", "_n")
    kept = n.withColumn("_set", F.array_distinct(F.coalesce(tokens, F.array().cast(dict(rows.dtypes)[tokens]))))
    lists = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_r", "_n", "score", F.col("_set").alias("tokens")))).alias("_all"))
    kind = f"struct<kept:array<int>,sets:array<{dict(rows.dtypes)[tokens]}>>"
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.array().cast(f"array<{dict(rows.dtypes)[tokens]}>").alias("sets")).cast(kind)

    def step(state: Column, x: Column) -> Column:
        overlap = lambda y: F.coalesce(F.size(F.array_intersect(x["tokens"], y)) / F.nullif(F.size(F.array_union(x["tokens"], y)), F.lit(0)), F.lit(0.0))
        most = F.coalesce(F.array_max(F.transform(state["sets"], overlap)), F.lit(0.0))
        stays = (x["_n"] <= 3) | (x["_r"] <= 5) | ((1 - penalty) * x["score"] - penalty * most * x["score"] > 0)
        grown = F.struct(F.array_append(state["kept"], x["_r"]).alias("kept"), F.array_append(state["sets"], x["tokens"]).alias("sets")).cast(kind)
        return F.when(stays, grown).otherwise(state)

    chosen = lists.select("query_id", F.explode(F.aggregate("_all", start, step)["kept"]).alias("_r"))
    return n.join(chosen, ["query_id", "_r"], "left_semi").drop("_r", "_n").select(rows.columns)


def path_entropy(rows: DataFrame) -> DataFrame:
    """(query_id, path_entropy): entropy in bits of the first path segments."""
    counts = rows.groupBy("query_id", F.substring_index("rel_path", "/", 1).alias("d")).agg(F.count("*").alias("c"))
    p = counts.withColumn("p", F.col("c") / F.sum("c").over(W.partitionBy("query_id")))
    return p.groupBy("query_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("path_entropy"))


def coverage(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, coverage): the share of a query's telling terms that any of its chunks holds."""
    told = queries.select("query_id", F.lower("term").alias("term")).filter((F.char_length("term") > 1) & ~F.col("term").isin(T.STOPWORDS)).distinct()
    found = rows.select("query_id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("term")).distinct().withColumn("hit", F.lit(1))
    return told.join(found, ["query_id", "term"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("coverage"))


def quality_label(coverage_: Column, entropy: Column, has_definition: Column, top_score: Column) -> Column:
    """struct(flags, label) from the four signs of weak retrieval."""
    flags = F.filter(F.array(F.when(coverage_ < 0.5, "low_coverage"), F.when(entropy < 0.5, "mono_dir"), F.when(~has_definition, "no_def"), F.when(~(top_score > 10.0), "flat_score")), lambda x: x.isNotNull())
    label = F.when((F.size(flags) >= 2) | (entropy < 0.5), "weak").when(F.size(flags) == 1, "mixed").otherwise("strong")
    return F.struct(flags.alias("flags"), label.alias("label"))


def has_definition(chunk_type: Column, content: Column) -> Column:
    return chunk_type.isin("function", "class", "method") | F.rlike(content, F.lit(r"\b(def |class |function )\w"))


def expand_to_next(chunks: DataFrame, unfinished: Column) -> DataFrame:
    """Chunks with `content` extended by the next chunk of the file where `unfinished` holds."""
    own = W.partitionBy("rel_path").orderBy("chunk_index")
    following = F.lead("content").over(own)
    return chunks.withColumn("_next", following).withColumn("expanded", unfinished & F.col("_next").isNotNull() & (F.col("_next") != "")).withColumn("content", F.when(F.col("expanded"), F.concat_ws("\n", "content", "_next")).otherwise(F.col("content"))).drop("_next")


def mode_metrics(rows: DataFrame) -> DataFrame:
    """(mode, precision_at_5, hit_rate, tokens) from (query_id, mode, rank, relevant, tokens)."""
    per = rows.groupBy("mode", "query_id").agg((F.sum(F.when((F.col("rank") <= 5) & F.col("relevant"), 1).otherwise(0)) / 5).alias("p5"), F.max(F.col("relevant").cast("int")).alias("hit"), F.sum("tokens").alias("tokens"))
    return per.groupBy("mode").agg(F.avg("p5").alias("precision_at_5"), F.avg("hit").alias("hit_rate"), F.sum("tokens").alias("tokens"))


def split_completion(ranked_chunks: DataFrame, chunks: DataFrame, top: int = 15) -> DataFrame:
    """Missing parts of symbols that were split, where at least half of the parts are among the top ranks.

    Parts of one symbol share rel_path and chunk_index - split_part.
    """
    base = (F.col("chunk_index") - F.col("split_part")).alias("base")
    parts = chunks.filter("split_of > 1").select("rel_path", base, "split_of", "split_part", "chunk_id")
    have = ranked_chunks.filter(F.col("rank") <= top).select("query_id", "chunk_id").join(parts, "chunk_id")
    groups = have.groupBy("query_id", "rel_path", "base", "split_of").agg(F.count("*").alias("n")).filter("n < split_of and n >= 0.5 * split_of")
    missing = groups.select("query_id", "rel_path", "base").join(parts, ["rel_path", "base"])
    return missing.join(have.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "rel_path", "chunk_id", "split_part")
