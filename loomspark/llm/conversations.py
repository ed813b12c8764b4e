"""Operator 2, chat formatting with cumulative-snapshot collapse (DataFrame functions only).

Logs often hold one conversation many times, each snapshot a turn longer than the last.  A rolling hash over
the turns gives every conversation the hashes of all its prefixes; a conversation whose whole hash is a
proper prefix of another, or equals that of one with a smaller id, is dropped by anti-join, and the maximal
ones are rendered.

Until then only digests of turns are handled.  They are dealt by ranges of (conversation, turn), so that a
conversation with a third of all turns lies in many blocks: a turn's place is its place in its block plus the
turns in the blocks before, and the rolling hash is the sum of the digests of (place, turn) in the block plus
the sums of the blocks before.  A conversation is rendered in parts of at most PART_TURNS turns, so no row
grows with a conversation.  Prefix hashes are made distinct before they are shuffled: a first turn that a third
of all conversations share is one row of each task.

Defined results: a null role or text differs from an empty one in the hash and is rendered empty; a null turn
comes first; rows of the same conversation and turn go by their digests, exact repeats count once; a row without a
conv_id is a conversation of one turn; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.llm import common

PART_TURNS = 1000
_SUMS = ["s0", "s1", "s2", "s3"]


def _marked(x: Column) -> Column:
    """A string that tells null from empty and where it ends."""
    return F.coalesce(F.concat(F.char_length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn of the chat template."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def keyed_turns(turns: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, digest, role, text): conv names the conversation, digest what the turn says."""
    digest = F.sha2(F.concat(_marked(F.col("role")), _marked(F.col("text"))), 256)
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("digest", digest)
    conv = F.coalesce(F.concat(F.lit("id:"), F.col("conv_id").cast("string")), F.concat(F.lit("row:"), _marked(F.col("turn").cast("string")), F.col("digest")))
    return rows.withColumn("conv", conv)


def rolled(keyed: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, digest, place, n_turns, prefix): prefix is the rolling hash of the turns up to this one."""
    n = common.partitions(keyed.sparkSession)
    dealt = keyed.select("conv", "conv_id", "turn", "digest").distinct().repartitionByRange(n, "conv", "turn", "digest")
    dealt = common.checkpoint(dealt.withColumn("block", F.spark_partition_id()))
    whole, before = W.partitionBy("conv"), W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy("conv", "block").agg(F.count("*").alias("n"))
    counts = counts.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("n_turns"))
    own = W.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "digest")
    placed = dealt.join(counts, ["conv", "block"]).withColumn("place", F.col("offset") + F.row_number().over(own))
    term = F.sha2(F.concat_ws(":", "place", "digest"), 256)
    placed = placed.withColumns({s: F.conv(F.substring(term, 8 * k + 1, 8), 16, 10).cast("long") for k, s in enumerate(_SUMS)})
    sums = placed.groupBy("conv", "block").agg(*[F.sum(s).alias(s) for s in _SUMS])
    base = sums.select("conv", "block", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in _SUMS])
    running = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    prefix = F.concat_ws(":", "place", *[F.sum(s).over(running) + F.col(f"{s}_before") for s in _SUMS])
    return placed.join(base, ["conv", "block"]).select("conv", "conv_id", "turn", "digest", "place", "n_turns", prefix.alias("prefix"))


def collapse(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, rendered) of the maximal conversations; parts are numbered from 0."""
    keyed = keyed_turns(turns)
    all_ = common.checkpoint(rolled(keyed))
    inner = all_.filter("place < n_turns").select("prefix").distinct()
    first = F.min(F.struct(F.col("conv_id").isNull().alias("unnamed"), "conv_id", "conv")).alias("first")
    kept = all_.filter("place = n_turns").groupBy("prefix").agg(first).join(inner, "prefix", "left_anti").select("first.conv")
    places = all_.join(kept, "conv", "left_semi").select("conv", "turn", "digest", "n_turns", "place", F.floor((F.col("place") - 1) / part_turns).cast("int").alias("part"))
    same = [keyed["conv"] == places["conv"], keyed["turn"].eqNullSafe(places["turn"]), keyed["digest"] == places["digest"]]
    pieces = keyed.join(places, same).select(keyed["conv"], "conv_id", "part", "n_turns", "place", rendered_turn(F.col("role"), F.col("text")).alias("piece"))
    parts = pieces.groupBy("conv", "conv_id", "part", "n_turns").agg(F.sort_array(F.collect_set(F.struct("place", "piece"))).alias("turns"))
    return parts.select("conv_id", "part", F.col("n_turns").cast("int").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("rendered"))


def op2_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(common.read(spark, sf_dir, "conversations"))


ORACLE = """
WITH d AS (SELECT *, coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-') AS said FROM conversations),
r AS (SELECT DISTINCT coalesce('id:' || conv_id, 'row:' || coalesce(turn, -1) || said) AS conv, conv_id, turn, role, text, said, sha256(said) AS digest FROM d),
t AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, digest) AS k, count(*) OVER (PARTITION BY conv) AS n FROM r),
p AS (SELECT a.conv, a.conv_id, a.k, a.n, string_agg(b.said, '' ORDER BY b.k) AS prefix FROM t a JOIN t b ON a.conv = b.conv AND b.k <= a.k GROUP BY a.conv, a.conv_id, a.k, a.n),
e AS (SELECT prefix, arg_min(conv, (conv_id IS NULL, coalesce(conv_id, 0), conv)) AS conv FROM p WHERE k = n GROUP BY prefix),
m AS (SELECT conv FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.prefix = e.prefix))
SELECT conv_id, CAST((k - 1) // 1000 AS INTEGER) AS part, CAST(n AS INTEGER) AS n_turns, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY k) AS rendered
FROM t WHERE conv IN (SELECT conv FROM m) GROUP BY conv, conv_id, (k - 1) // 1000, n
"""

QUERIES = {"op2_chat_collapse": op2_chat_collapse}
ORACLES = {"op2_chat_collapse": ORACLE}
