"""Comparing the members of long lists exactly, in blocks of bounded size.

Operators that find candidates by something that sets share (a token, a signature band) get lists of sets.  Short
ones become pairs; a long one is dealt by size class (linked sets lie in one class or in neighbours) and cut
into blocks, and each pair of blocks is one group of one task.  A task keeps the pairs that share a token of
their prefix under ascending and under descending hash order, verifies what passes both, and returns one link for
each pair of components.  The pairs of blocks of a list grow with the square of its length, which an exact
comparison of all its members cannot avoid; lists are therefore first thinned by hubs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import common

#: Sets, and tokens at most (but for one set), in a block.
BLOCK_SETS, BLOCK_TOKENS = 512, 1 << 19
#: Rows (a name and a number each, 32 MB) up to which a counted table is broadcast.
BROADCAST_ROWS = 1_000_000
_WIDTH = 4096


def need(n: int, percent: int) -> int:
    """Least overlap with which a set of n tokens can reach the threshold."""
    return -(-n * percent // 100)


def small(df: DataFrame, count: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if count <= most else df


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link; the filters under ascending and descending hash order come first."""
    m, n = len(a), len(b)
    if 100 * min(m, n) < percent * max(m, n) or not m or not n:
        return False
    p, q = m - need(m, percent) + 1, n - need(n, percent) + 1
    if not len(np.intersect1d(a[:p], b[:q], assume_unique=True)) or not len(np.intersect1d(a[-p:], b[-q:], assume_unique=True)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (m + n - both)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, by matrix products over the tokens that several sets have."""
    m = len(sets)
    both = np.zeros((m, m), dtype=np.float32)
    if not sum(map(len, sets)):
        return both
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    seen = np.bincount(at)
    often = seen[at] > 1
    owner = np.repeat(np.arange(m), [len(s) for s in sets])[often]
    at = (np.cumsum(seen > 1) - 1)[at[often]]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, _WIDTH):
        lo, hi = np.searchsorted(at, [start, start + _WIDTH])
        part = np.zeros((m, _WIDTH), dtype=np.float32)
        part[owner[lo:hi], at[lo:hi] - start] = 1
        both += part @ part.T
    return both


def compare(sets: list[np.ndarray], component: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked sets of different components, one pair for each two components."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    prefix = [n - need(n, percent) + 1 if n else 0 for n in sizes.tolist()]
    maybe = shared_counts([s[:p] for s, p in zip(sets, prefix, strict=True)]) > 0
    maybe &= shared_counts([s[len(s) - p :] for s, p in zip(sets, prefix, strict=True)]) > 0
    maybe &= component[:, None] != component[None, :]
    least = -(-percent * sizes // 100)  # a partner's least size
    maybe &= (sizes[:, None] >= least[None, :]) & (sizes[None, :] >= least[:, None])
    i, j = np.nonzero(np.triu(maybe, 1))
    if len(i) > 8 * len(sets):
        both = shared_counts(sets)[i, j].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    ok = 100 * both >= percent * (sizes[i] + sizes[j] - both)
    i, j = i[ok], j[ok]
    if not len(i):
        return i, j
    lo, hi = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
    _, one = np.unique(np.stack([lo, hi]), axis=1, return_index=True)
    return i[one], j[one]


def block_links(lists: DataFrame, payload: DataFrame, sets_of: Callable[[list[bytes]], list[np.ndarray]], percent: int) -> DataFrame:
    """Links (src, dst) between components inside lists (token, id, n: size of its set, component).

    payload (id, payload) gives each set's bytes, sets_of makes sorted sets of them.
    """
    classed = lists.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) - 1e-9).cast("int"))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_TOKENS) / F.col("n")))).cast("long")
    sized = classed.groupBy("token", "size_class").agg(F.count("*").alias("members"), F.min(most).alias("most"))
    blocks = common.checkpoint(sized.withColumn("blocks", F.ceil(F.col("members") / F.col("most")).cast("int")).select("token", "size_class", "blocks"))
    count = blocks.count()
    cut = classed.join(small(blocks, count), ["token", "size_class"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    a = blocks.select("token", F.col("size_class").alias("ac"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("ab"))
    b = a.select("token", F.col("ac").alias("bc"), F.col("ab").alias("bb"))
    tasks = a.join(b, "token").filter("(bc = ac and bb >= ab) or bc = ac + 1")
    named = tasks.withColumn("task", F.sha2(F.concat_ws("/", F.hex("token"), "ac", "ab", "bc", "bb"), 256))
    sides = named.select("task", "token", F.col("ac").alias("size_class"), F.col("ab").alias("block")).union(named.select("task", "token", "bc", "bb")).distinct()
    rows = sides.join(cut, ["token", "size_class", "block"]).select("task", "id", "component").join(payload, "id").select("task", "id", "component", "payload")
    kind = lists.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id")
        _, component = np.unique(np.array(table.column("component").to_pylist(), dtype=object), return_inverse=True)
        i, j = compare(sets_of(table.column("payload").to_pylist()), component, percent)
        return pa.table({"src": ids.take(pa.array(i, pa.int64())), "dst": ids.take(pa.array(j, pa.int64()))})

    return rows.groupBy("task").applyInArrow(run, f"src {kind}, dst {kind}")


def verified(pairs: DataFrame, payload: DataFrame, sets_of: Callable[[list[bytes]], list[np.ndarray]], percent: int) -> DataFrame:
    """The pairs (src, dst) that link; payload as in block_links."""
    kind = pairs.schema["src"].dataType.simpleString()
    arrow = pa.binary() if kind == "binary" else pa.int64()

    def check(part: dict) -> dict:
        x, y = sets_of(part["x"]), sets_of(part["y"])
        keep = [k for k in range(len(x)) if linked(x[k], y[k], percent)]
        return {side: [part[side][k] for k in keep] for side in ("src", "dst")}

    x = payload.select(F.col("id").alias("src"), F.col("payload").alias("x"))
    y = payload.select(F.col("id").alias("dst"), F.col("payload").alias("y"))
    joined = pairs.join(x, "src").join(y, "dst").select("src", "dst", "x", "y")
    return common.map_batches(joined, check, f"src {kind}, dst {kind}", pa.schema([("src", arrow), ("dst", arrow)]))
