"""Symbol search, listings and manifest differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


GRAM = 3


def _grams(text: Column, n: Column) -> Column:
    """All distinct substrings of n characters."""
    return F.when(F.char_length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substr(text, i, n))))


def search(symbols: DataFrame, queries: DataFrame, limit: int = 120) -> DataFrame:
    """(query_id, name, match_rank) for each query (query_id, q): names that contain it, ignoring case.

    An exact name is 0, a beginning 1, else 2.  Names within two edits (rank 3) count only where nothing contains
    the query.  Both are equi-joins on grams, then verified: a name that contains the query holds the query's
    first three characters (fewer if it is shorter); of three pieces of a query, two edits leave one whole, which the
    name holds no more than two places off.  Queries of under three characters, which have no three pieces, meet the names
    of up to five characters by length.  Empty queries match every name.
    """
    from pyspark.sql import Window as W

    names = symbols.select("name").distinct().withColumn("low", F.lower("name"))
    asked = queries.withColumn("ql", F.lower("q"))
    sizes = F.array(*[F.lit(n) for n in range(GRAM + 1)])
    indexed = names.select("name", "low", F.explode(sizes).alias("n")).select("name", "low", F.explode(F.when(F.col("n") == 0, F.array(F.lit(""))).otherwise(_grams(F.col("low"), F.greatest(F.lit(1), F.col("n"))))).alias("gram"))
    rank = F.when(F.col("low") == F.col("ql"), 0).when(F.startswith("low", "ql"), 1).otherwise(2)
    hits = indexed.join(asked.withColumn("gram", F.substring("ql", 1, GRAM)), "gram").filter(F.contains("low", "ql")).select("query_id", "name", rank.alias("match_rank"))
    left = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti").withColumn("m", F.char_length("ql"))

    # pieces of m div 3, m div 3, and the rest; a name's gram of that length at a place up to two off
    third = F.floor(F.col("m") / 3).cast("int")
    cuts = F.array(F.struct(F.lit(1).alias("at"), third.alias("len")), F.struct((third + 1).alias("at"), third.alias("len")), F.struct((2 * third + 1).alias("at"), (F.col("m") - 2 * third).alias("len")))
    pieces = left.filter("m >= 3").select("query_id", "ql", "m", F.explode(cuts).alias("c"))
    spread = pieces.select("query_id", "ql", "m", "c", F.substr("ql", F.col("c.at"), F.col("c.len")).alias("gram")).withColumn("at", F.explode(F.sequence(F.greatest(F.lit(1), F.col("c.at") - 2), F.col("c.at") + 2)))
    lengths = spread.select(F.char_length("gram").alias("n")).distinct()  # a handful: no more than a query has characters
    placed = names.withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("low"))))).join(F.broadcast(lengths), "n").select("name", "low", "n", F.explode(F.sequence(F.lit(1), F.char_length("low") - F.col("n") + 1)).alias("at"))
    placed = placed.select("name", "low", "at", F.substr("low", F.col("at"), F.col("n")).alias("gram"))
    long_ = placed.join(spread.select("query_id", "ql", "gram", "at"), ["gram", "at"]).select("query_id", "ql", "name", "low").distinct()
    short = left.filter("m < 3").withColumn("len", F.explode(F.sequence(F.greatest(F.lit(0), F.col("m") - 2), F.col("m") + 2)))
    brief = names.withColumn("len", F.char_length("low")).filter("len < 5").join(short, "len").select("query_id", "ql", "name", "low")
    fuzzy = long_.unionByName(brief).filter(F.levenshtein("ql", "low", 2) >= 0)
    every = hits.unionByName(fuzzy.select("query_id", "name", F.lit(3).alias("match_rank")))
    own = W.partitionBy("query_id").orderBy("match_rank", F.lower("name"), "name")
    return every.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= limit).select("query_id", "name", "match_rank")


def containing(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column is like the pattern, ignoring case (wildcards stay live)."""
    return df.filter(F.col(column).ilike(f"%{part}%"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def manifest_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(rel_path, change): new, changed or unchanged by (checksum, size, mtime), and deleted."""
    old = before.select("rel_path", F.struct("checksum", "size_bytes", "mtime").alias("old"))
    new = now.select("rel_path", F.struct("checksum", "size_bytes", "mtime").alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return new.join(old, "rel_path", "full_outer").select("rel_path", change.alias("change"))


# What file edges have again once they are copied, as their table's own defaults.
COPIED_FILE_EDGES = {"confidence_score": 1.0, "resolution_method": "import_statement"}


def copy_unchanged(edges: DataFrame, diff: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Edges whose source file is unchanged, for the next snapshot; symbol edges as they are, file edges with COPIED_FILE_EDGES as `defaults`."""
    kept = edges.join(diff.filter("change = 'unchanged'").select(F.col("rel_path").alias("src")), "src", "left_semi")
    return kept.withColumns({c: F.lit(v) for c, v in (defaults or {}).items()})


def previous_snapshot(snapshots: DataFrame, current: str) -> DataFrame:
    """The newest snapshot other than the current one."""
    return snapshots.filter(F.col("id") != current).orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def path_tree(files: DataFrame) -> DataFrame:
    """(path, is_dir): every file and every directory above it, once."""
    from loomspark.functions.paths import ancestors

    every = files.select("path", F.explode(ancestors(F.col("path"))).alias("node"))
    return every.groupBy("node").agg(F.bool_or(F.col("node") != F.col("path")).alias("is_dir")).select(F.col("node").alias("path"), "is_dir")


def export_edges(edges: DataFrame, nodes: DataFrame, left_out: str) -> DataFrame:
    """Edges (src, dst, external, ...) for an export: neither end matches the pattern `left_out`, and the source of an internal one is one of the nodes (node)."""
    kept = edges.filter(~F.rlike("src", F.lit(left_out)) & ~F.rlike("dst", F.lit(left_out)))
    known = nodes.select(F.col("node").alias("src")).distinct().withColumn("_known", F.lit(True))
    return kept.join(known, "src", "left").filter("external or _known").drop("_known")


def export_rows(symbols: DataFrame, snapshot: str, columns: list[str]) -> DataFrame:
    """(place, row): distinct rows outside test paths, quoted for CSV, numbered by path, line and name; the snapshot comes first."""
    from pyspark.sql import Window as W

    from loomspark.functions.paths import is_test_path

    rows = symbols.filter(~is_test_path(F.col("rel_path"))).select(*columns).distinct()
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    # numbers within a file: the files themselves are in order of their paths
    own = W.partitionBy("rel_path").orderBy("line", "name", *[c for c in columns if c not in ("rel_path", "line", "name")])
    return rows.select("rel_path", F.row_number().over(own).alias("place"), F.concat_ws(",", F.lit(f'"{snapshot}"'), *quoted).alias("row"))
