"""Operator 9, exact top-k search by inner product, with norm-bucketed retrieval.

Vectors are grouped by length: a range holds lengths within 4.5 percent, and a range with many vectors is dealt by
hash into parts, so that a bucket (range, part) has a bounded number of vectors and bytes and is packed as one row.  A first pass over
some of the longest vectors gives each query a score that its k-th best certainly reaches, and with it the
shortest length that a better candidate may have.  Queries are then packed into blocks of one such range each, and a
block meets only the buckets from that range upwards: this is decided on bucket names, before any vector is
shipped.

For each query of a block and each bucket a task derives the local cosine threshold: above 1 nothing in the
bucket can reach the score and it is skipped; a low one is pruned by length alone; otherwise by coordinates, where
the product over the query's largest coordinates plus a Cauchy-Schwarz bound on the others must reach the
score.  What is left is verified with exact integer products.

Defined results: vectors that are null or hold null or non-finite components take no part; rows that share a
vec_id are one vector (the smallest); vectors of different dimension have no product; a query with fewer
candidates gets them all; ties go to the smaller vec_id; an empty table gives an empty result; extra columns are
ignored.  Scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.llm import common

K, EVERY, SCALE = 5, 50, 256
#: Vectors in a bucket, between these bounds so that a session's partitions have several each, and its bytes at most; queries in a block.
BUCKETS, BUCKET_BYTES, BLOCK = (2048, 32_768), 16 << 20, 512
#: Length ranges for each doubling of the squared length.
RANGES = 8
#: Bucket names up to this count are broadcast (a few MB).
BROADCAST_NAMES = 100_000
#: Coordinates of a query that are looked at first, as a share of all, and the cosine from which they are.
FOCUS, COSINE = 0.25, 0.2
_SCORES = "query_id long, vec_id long, score long"
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors that take part, one row a vec_id."""
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(ok & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def length_range(square: Column) -> Column:
    """The range of a squared length; never falls as the length grows."""
    return F.floor(RANGES * F.log2(square + 1)).cast("int")


def _matrix(rows: np.ndarray) -> bytes:
    """Rows of integers as bytes, 32 bits each where that holds them all."""
    small = not rows.size or np.abs(rows).max() < 2**31
    return rows.astype(np.int32 if small else np.int64).tobytes()


def _unpacked(ids: bytes, m: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    small = len(m) == 4 * len(names) * d
    return names, np.frombuffer(m, np.int32 if small else np.int64).reshape(len(names), d).astype(np.int64)


def _packed(rows: DataFrame, by: list[str], least: bool = False) -> DataFrame:
    """One row for each value of `by` (integers; rows of bounded number): ids, components and bounds as binary."""
    names = [f for f in rows.schema.fields if f.name in by]

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        made = {f.name: pa.array([k.as_py()], pa.int32()) for f, k in zip(names, key, strict=True)}
        made |= {"ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "m": pa.array([_matrix(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False))], pa.binary())}
        if least:
            made["least"] = pa.array([table.column("least").to_numpy().tobytes()], pa.binary())
        return pa.table(made)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names) + ", ids binary, m binary" + (", least binary" if least else "")
    return rows.groupBy(*[f.name for f in names]).applyInArrow(pack, schema)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = (scores >= least).nonzero()[0]
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def search_bucket(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> tuple[list, list, list]:
    """Best k of a bucket for each query, among what can reach the score `least`."""
    d = m.shape[1]
    f = m.astype(np.float64)
    squares = f * f
    length = np.sqrt(squares.sum(axis=1))
    longest = float(length.max())
    most = float(np.abs(f).max()) if d else 0.0
    out: tuple[list, list, list] = ([], [], [])
    focus = max(1, int(d * FOCUS)) if d else 0
    for qid, vector, bound in zip(q_ids, q, least, strict=True):
        own = vector.astype(np.float64)
        size = float(np.sqrt(own @ own))
        reach = size * longest
        if bound > reach * (1 + 1e-9) + 1e-6:
            continue  # by length, the whole bucket
        cosine = bound / reach if reach else 0.0
        if cosine >= COSINE and focus < d:
            at = np.argpartition(-np.abs(own), focus)[:focus]
            rest = np.sqrt(np.maximum(own @ own - own[at] @ own[at], 0))
            tail = np.sqrt(np.maximum(length**2 - squares[:, at].sum(axis=1), 0))
            some = (f[:, at] @ own[at] + rest * tail >= bound - 1e-6 * max(1.0, abs(bound))).nonzero()[0]
        else:
            some = (size * length >= bound - 1e-6 * max(1.0, abs(bound))).nonzero()[0]
        some = some[ids[some] != qid]
        if not len(some):
            continue
        # doubles hold the products exactly while they stay below 2**53
        exact = not d or most * float(np.abs(own).max()) * d < 2**53
        scores = (f[some] @ own).astype(np.int64) if exact else m[some] @ vector
        reached = scores >= bound
        some, scores = some[reached], scores[reached]
        top = best_of(ids[some], scores, k)
        out[0].extend([int(qid)] * len(top))
        out[1].extend(ids[some][top].tolist())
        out[2].extend(scores[top].tolist())
    return out


def _bounds(pairs: DataFrame, k: int) -> DataFrame:
    """(vec_id, least) from rows (d, q_ids, q_m, ids, m): each query's k-th best score in the bucket, if it has so many."""
    schema = pa.schema([("vec_id", pa.int64()), ("least", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _unpacked(row["q_ids"], row["q_m"], row["d"])
                ids, m = _unpacked(row["ids"], row["m"], row["d"])
                got = search_bucket(q_ids, q, np.full(len(q_ids), -np.inf), ids, m, k)
                found: dict[int, list[int]] = {}
                for a, s in zip(got[0], got[2], strict=True):
                    found.setdefault(a, []).append(s)
                least = [float(found[a][k - 1]) if len(found.get(a, ())) >= k else float("-inf") for a in q_ids.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(least, pa.float64())], schema=schema)

    return pairs.select("d", "q_ids", "q_m", "ids", "m").mapInArrow(run, "vec_id long, least double")


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the best in each row's bucket for each query of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # rows are large: one at a time
                (row,) = batch.slice(at, 1).to_pylist()
                q_ids, q = _unpacked(row["q_ids"], row["q_m"], row["d"])
                ids, m = _unpacked(row["ids"], row["m"], row["d"])
                got = search_bucket(q_ids, q, np.frombuffer(row["least"], np.float64), ids, m, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], schema=_SCHEMA)

    return pairs.select("d", "q_ids", "q_m", "least", "ids", "m").mapInArrow(run, _SCORES)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates among all other vectors."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = common.checkpoint(integers(vectors, scale).withColumn("d", F.size("v")).withColumn("square", square).withColumn("range", length_range(F.col("square"))))
    n, n_queries = v.agg(F.count("*"), F.count_if(is_query)).first()
    partitions = common.partitions(vectors.sparkSession)
    size = min(max(n // (4 * partitions), BUCKETS[0]), BUCKETS[1])
    most = F.greatest(F.lit(1), F.least(F.lit(size), F.floor(F.lit(BUCKET_BYTES) / (8 * F.greatest(F.lit(1), F.col("d"))))))  # vectors of a bucket
    names = common.checkpoint(v.groupBy("d", "range").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / most).cast("int")))
    small = F.broadcast if names.count() <= BROADCAST_NAMES else (lambda x: x)
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    bucketed = v.join(small(names.drop("n")), ["d", "range"]).select("d", "range", part.alias("part"), "vec_id", "v")
    buckets = common.checkpoint(_packed(bucketed, ["d", "range", "part"]))

    # a bound for each query, from some of the longest vectors of its dimension (a bucket's worth), which salts repeat
    blocks_n = max(1, -(-n_queries // BLOCK))
    salts = min(partitions, blocks_n)
    hashed = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks_n)).cast("int")
    blocks = _packed(v.filter(is_query).select("d", hashed.alias("block"), "vec_id", "v"), ["d", "block"])
    blocks = blocks.withColumnsRenamed({"ids": "q_ids", "m": "q_m"}).withColumn("salt", F.col("block") % salts)
    longer = F.sum("n").over(W.partitionBy("d").orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1))
    top = names.withColumn("longer", F.coalesce(longer, F.lit(0))).filter(F.col("longer") < most).select("d", "range", F.lit(0).alias("part"))
    longest = _packed(bucketed.join(small(top), ["d", "range", "part"]).select("d", "vec_id", "v"), ["d"])
    longest = longest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    bounds = common.checkpoint(_bounds(blocks.join(longest, ["d", "salt"]), k))

    # blocks of queries that need the same range of lengths; a range lower, as logarithms are rounded
    needed = F.greatest(F.lit(0.0), F.col("least")) / F.sqrt("square")
    first = F.when((F.col("square") > 0) & (F.col("least") > 0), length_range(needed * needed) - 1).otherwise(0)
    asked = v.filter(is_query).join(bounds, "vec_id").withColumn("first", first)
    counts = asked.groupBy("d", "first").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_parts"))
    asked = asked.join(counts, ["d", "first"]).withColumn("q_part", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("q_parts")).cast("int"))
    packed = common.checkpoint(_packed(asked.select("d", "first", "q_part", "vec_id", "v", "least"), ["d", "first", "q_part"], least=True).withColumnsRenamed({"ids": "q_ids", "m": "q_m"}))
    meets = packed.select("d", "first", "q_part").join(small(names.drop("n")), "d").filter("range >= first")
    meets = meets.select("d", "first", "q_part", "range", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = meets.join(packed, ["d", "first", "q_part"]).join(buckets, ["d", "range", "part"])
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = _search(pairs, k).withColumn("rank", F.row_number().over(own))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), e AS (
  SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.i = b.i AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
  GROUP BY a.vec_id, b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

QUERIES = {"op9_top_k": op9_top_k}
ORACLES = {"op9_top_k": ORACLE}
