"""Communities of a file graph: edge preparation, Louvain-style moves, absorption, summaries.

Moves run as Spark rounds over the whole graph: every node sees its neighbours' communities as weighted sums
and may move to the best one; a node moves only in the rounds of its own parity class (a hash of its
name and the round), which keeps neighbours from swapping for ever.  Edges lie as arrays in blocks of nodes, whose
number grows with the edges, so that size does not matter; with a node of too many edges for a block, rounds are joins
of rows.  Labels differ from a sequential Louvain's, modularity is what counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.sources.tables import bucketed, checkpoint

RESOLUTION = 0.4
PSEUDO = ("__external__/", "__unresolved__/", "__synthetic__/")


def prepared_edges(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: without pseudo nodes and self-loops, repeated edges as weight."""
    real = edges
    for p in PSEUDO:
        real = real.filter(~F.col("src").startswith(p) & ~F.col("dst").startswith(p))
    return real.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").cast("double").alias("weight"))


#: Up to this many nodes, a round sends their labels to all executors (some 100 MB); more are joined by shuffles.
BROADCAST_NODES = 2_000_000


#: A block of nodes has about so many edges; with more edges at a single node, sums by node and community are made from rows.
BLOCK_EDGES, HUB_EDGES = 1_000_000, 4_000_000
#: Edges that a task holds until they are written as arrays, and rounds after which the nodes' turns repeat.
HELD_EDGES, TURNS = 2_000_000, 31


def _turn(node: str, r: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(r % TURNS)), F.lit(2)) == 0


def _moved(both: DataFrame, rounds: int, resolution: float) -> DataFrame:
    """(node, community) after at most `rounds` rounds of moves over edges (a, b, weight) in both directions; loops count in degrees only.

    Nodes are numbers.  Edges lie in blocks of nodes, as arrays, unless a node has too many of them for one block.
    """
    degrees = both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k"), F.count("*").alias("edges"), F.max("weight").alias("heaviest"), F.bool_and(F.col("weight") == F.floor("weight")).alias("whole")).withColumn("community", F.col("node"))
    labels = checkpoint(degrees)
    n, two_m, edges, most, top, heaviest, whole = labels.agg(F.count("*"), F.sum("k"), F.sum("edges"), F.max("edges"), F.max("node"), F.max("heaviest"), F.bool_and("whole")).first()
    labels = labels.select("node", "k", "community")
    if not two_m:
        return labels.select("node", "community")
    if most > HUB_EDGES:
        return _moved_by_rows(both, labels, n, two_m, rounds, resolution)
    # the shortest numbers that hold nodes, weights and sums of weights exactly
    kinds = "u4" if top < 1 << 32 else "i8", "u1" if whole and heaviest < 1 << 8 else "f8", "u4" if whole and two_m < 1 << 32 else "f8"
    return _moved_by_blocks(both, labels, edges, two_m, top, kinds, rounds, resolution)


def _arrays(table: pa.Table, **kinds: str) -> list[np.ndarray]:
    """Columns of raw arrays, each as one array."""
    return [np.frombuffer(b"".join(table[name].to_pylist()), kind) for name, kind in kinds.items()]


def _dealt(block: np.ndarray, blocks: int, *columns: np.ndarray) -> list[pa.Array]:
    """The blocks that occur, in order, and for each the columns' values as raw arrays."""
    order = np.argsort(block.astype("u2") if blocks <= 1 << 16 else block, kind="stable")
    block = block[order]
    cuts = np.flatnonzero(np.diff(block)) + 1 if len(block) else np.zeros(0, int)
    found = block[np.r_[0, cuts]] if len(block) else block
    return [pa.array(found.astype("i4")), *(pa.array([x.tobytes() for x in np.split(column[order], cuts)][: len(found)], pa.binary()) for column in columns)]


def _sorted(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns in the order of the first."""
    order = np.argsort(table[names[0]].to_numpy())
    return [table[name].to_numpy()[order] for name in names]


def _packed(both: DataFrame, blocks: int, rounds: int, number: str, weights: str) -> DataFrame:
    """(block, a, b, weight, turns): the edges as raw arrays by the block of a; turns has a bit for each round that is b's turn."""
    turns = F.lit((1 << min(rounds, TURNS)) - 1).cast("long")
    for r in range(min(rounds, TURNS)):  # as _turn, in few operations
        turns = turns.bitwiseXOR(F.shiftleft(F.xxhash64("b", F.lit(r)).bitwiseAND(F.lit(1).cast("long")), r))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            a, b, weight, turn = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays(_dealt(a % blocks, blocks, a.astype(number), b.astype(number), weight.astype(weights), turn), ["block", "a", "b", "weight", "turns"])

        for batch in batches:
            held.append([batch[x].to_numpy() for x in ("a", "b", "weight", "turns")])
            if sum(len(x[0]) for x in held) >= HELD_EDGES:
                yield out()
        if held:
            yield out()

    rows = both.filter("a <> b").select("a", "b", "weight", turns.cast("int").alias("turns"))
    return rows.mapInArrow(task, "block int, a binary, b binary, weight binary, turns binary")


def _moved_by_blocks(both: DataFrame, labels: DataFrame, edges: int, two_m: float, top: int, kinds: tuple[str, str, str], rounds: int, resolution: float) -> DataFrame:
    """Rounds over blocks of nodes: a block's edges meet its nodes' communities as arrays and carry them, with the communities' totals, to the
    blocks of the nodes whose turn it is, which are few thousand rows of arrays instead of a row for each edge.  Edges stay in their buckets."""
    spark = both.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    blocks = max(edges // BLOCK_EDGES + 1, min(tasks, edges // 5000 + 1))
    number, weights, sums = kinds
    packed, name = bucketed(_packed(both, blocks, rounds, number, weights), min(blocks, max(tasks, blocks // 8)), "block")

    def carry(r: int):
        def task(edges: pa.Table, nodes: pa.Table) -> pa.Table:
            a, b, weight, turns = _arrays(edges, a=number, b=number, weight=weights, turns="i4")
            node, community, total = _sorted(nodes, "node", "community", "total")
            some = np.flatnonzero((turns >> r % TURNS) & 1)
            at = np.searchsorted(node, a[some])
            return pa.table(_dealt(b[some] % blocks, blocks, b[some], community[at].astype(number), weight[some], total.astype(sums)[at]), ["block", "node", "c", "weight", "total"])

        return task

    def settle(sent: pa.Table, nodes: pa.Table) -> pa.Table:
        node, k, community = _sorted(nodes, "node", "k", "community")
        moved = community.copy()
        b, c, weight, total = _arrays(sent, node=number, c=number, weight=weights, total=sums)
        if len(b):
            key = np.searchsorted(node, b) * (top + 1) + c.astype("i8")
            order = np.argsort(key)
            key = key[order]
            begin = np.flatnonzero(np.r_[True, np.diff(key) != 0])
            at, c = np.divmod(key[begin], top + 1)
            own = c == community[at]
            w, total = np.add.reduceat(weight[order].astype("f8"), begin), total[order[begin]].astype("f8")
            gain = np.round(w - resolution * k[at] * (total - np.where(own, k[at], 0.0)) / two_m, 9)
            first = np.flatnonzero(np.r_[True, np.diff(at) != 0])
            best = np.maximum.reduceat(gain, first)
            stay = np.zeros(len(node))
            stay[at[own]] = gain[own]
            # rows are in order of communities: the first of the best has the smallest name
            places = np.flatnonzero(gain == np.repeat(best, np.diff(np.r_[first, len(at)])))
            where, one = np.unique(at[places], return_index=True)
            better = best > stay[where]
            moved[where[better]] = c[places[one]][better]
        return pa.table([pa.array(node), pa.array(k), pa.array(moved), pa.array(moved != community)], ["node", "k", "community", "changed"])

    block = F.pmod("node", F.lit(blocks)).cast("int").alias("block")
    table, quiet = None, 0
    for r in range(rounds):
        totals = labels.groupBy("community").agg(F.sum("k").alias("total"))
        known = labels.join(totals, "community").select(block, "node", "community", "total")
        sent = packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(carry(r), "block int, node binary, c binary, weight binary, total binary")
        own = labels.select(block, "node", "k", "community").groupBy("block")
        settled = sent.groupBy("block").cogroup(own).applyInArrow(settle, "node long, k double, community long, changed boolean")
        table = checkpoint(settled, instead_of=table)
        labels = table.select("node", "k", "community")
        quiet = quiet + 1 if table.filter("changed").isEmpty() else 0
        if quiet >= 2:
            break
    spark.sql(f"DROP TABLE {name}")
    return labels.select("node", "community")


def _moved_by_rows(both: DataFrame, labels: DataFrame, n: int, two_m: float, rounds: int, resolution: float) -> DataFrame:
    """Rounds over rows: a round reads the edges of the nodes whose turn it is and no others; each edge brings its neighbour's community and
    that community's total along, so that only sums by node and community are shuffled."""
    sent = F.broadcast if n <= BROADCAST_NODES else lambda df: df
    table, quiet = None, 0
    for r in range(rounds):
        totals = labels.groupBy("community").agg(F.sum("k").alias("total"))
        there = labels.join(totals, "community").select(F.col("node").alias("b"), F.col("community").alias("c"), "total")
        near = both.filter("a <> b").filter(_turn("a", r)).join(sent(there), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("weight").alias("w"), F.first("total").alias("total"))
        own = F.col("c") == F.col("community")
        gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("total") - F.when(own, F.col("k")).otherwise(0.0)) / two_m, 9)
        gains = near.join(sent(labels), "node").select("node", "c", gain.alias("gain"), own.alias("own"))
        best = gains.groupBy("node").agg(F.max(F.struct("gain", "own", (-F.col("c")).alias("c"))).alias("x"), F.max(F.when(F.col("own"), F.col("gain"))).alias("stay"))
        better = best.filter(F.col("x.gain") > F.coalesce("stay", F.lit(0.0))).select("node", (-F.col("x.c")).alias("to"))
        moved = labels.join(better, "node", "left").withColumn("to", F.coalesce("to", "community"))
        table = checkpoint(moved.select("node", "k", F.col("to").alias("community"), (F.col("to") != F.col("community")).alias("changed")), instead_of=table)
        labels = table.select("node", "k", "community")
        quiet = quiet + 1 if table.filter("changed").isEmpty() else 0
        if quiet >= 2:
            break
    return labels.select("node", "community")


def _numbered(names: DataFrame) -> DataFrame:
    """(name, number) of distinct names, from 0 without gaps in the order of the names."""
    # spark's ids hold the partition above 33 bits: gaps between partitions are closed by the counts of those before
    placed = checkpoint(names.sort("name").select("name", F.monotonically_increasing_id().alias("_i"))).withColumn("_p", F.shiftright("_i", 33))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_start", before)  # a row for each partition
    return checkpoint(placed.join(F.broadcast(starts), "_p").select("name", (F.col("_start") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).alias("number")))


def _mirrored(edges: DataFrame, two: Column | None = None) -> DataFrame:
    """Edges (a, b, weight) in both directions; those that are not two, as loops, once."""
    one, other = (F.struct(F.col(x).alias("a"), F.col(y).alias("b"), "weight") for x, y in ("ab", "ba"))
    rows = F.array(one, other) if two is None else F.when(two, F.array(one, other)).otherwise(F.array(one))
    return edges.select(F.explode(rows).alias("_e")).select("_e.*")


def detect(weighted: DataFrame, rounds: int = 20, resolution: float = RESOLUTION) -> DataFrame:
    """(node, community), small communities absorbed, named by smallest member.

    Nodes move to better communities; then communities become the nodes of a smaller graph, whose edges carry their summed
    weights, and move in turn, until a level joins nothing.  Meanwhile names are numbers in the order of the names.
    """
    weighted = checkpoint(weighted.select("a", "b", "weight"))
    names = _numbered(weighted.select("a").union(weighted.select("b")).distinct().toDF("name")).withColumnRenamed("number", "node")
    sent = F.broadcast if names.count() <= BROADCAST_NODES else lambda df: df
    coded = weighted.join(sent(names.toDF("a", "x")), "a").join(sent(names.toDF("b", "y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "weight")
    # a node's edges lie together, so that they are summed before they are shuffled
    both = checkpoint(_mirrored(coded).repartition("a"))
    level, labels = both, None
    while True:
        found = checkpoint(_moved(level, rounds, resolution))
        labels = found if labels is None else checkpoint(labels.join(found.toDF("community", "upper"), "community").select("node", F.col("upper").alias("community")))
        # nodes that only change names, as two that swap theirs, join nothing
        if found.select("community").distinct().count() == found.count():
            break
        # of an edge's two directions one is joined
        joined = level.filter("a <= b").join(sent(found.toDF("a", "x")), "a").join(sent(found.toDF("b", "y")), "b").select("weight", F.col("x").alias("a"), F.col("y").alias("b"), (F.col("a") < F.col("b")).alias("two"))
        level = checkpoint(_mirrored(joined, F.col("two")).groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    placed = canonical(absorb(both, labels))
    return placed.join(names, "node").select(F.col("name").alias("_n"), F.col("community").alias("node")).join(names, "node").select(F.col("_n").alias("node"), F.col("name").alias("community"))


def absorb(both: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """Communities of fewer than `least` members join the neighbour community with most edges, ties to the smallest name.

    They move one after another by name, so that a later one sees where earlier ones went; any neighbour community may win.  As a
    community's votes depend on its neighbours only, each round moves all small ones whose small neighbours of smaller names have moved:
    the result is that of one after another, in as many rounds as the longest chain of neighbours with rising names.
    """
    sizes = labels.groupBy("community").agg(F.count("*").alias("n"))
    waiting = checkpoint(sizes.filter(F.col("n") < least).select("community"))
    if waiting.isEmpty():
        return labels
    moving = labels.join(waiting, "community", "left_semi").select(F.col("node").alias("a"), F.col("community").alias("ca"))
    out = both.filter("a <> b").join(moving, "a").join(labels.withColumnsRenamed({"node": "b", "community": "cb"}), "b").filter("ca <> cb")
    # between communities as they were; a community moves as a whole, so that its present name is where it went
    votes = checkpoint(out.groupBy("ca", "cb").agg(F.sum("weight").alias("w")))
    before = checkpoint(votes.filter("cb < ca").join(waiting.withColumnRenamed("community", "cb"), "cb", "left_semi").select("ca", "cb"))
    moved = checkpoint(waiting.select(F.col("community").alias("cb"), F.col("community").alias("to")).limit(0))
    while not waiting.isEmpty():
        open_ = before.join(waiting.withColumnRenamed("community", "cb"), "cb", "left_semi").select(F.col("ca").alias("community")).distinct()
        ready = checkpoint(waiting.join(open_, "community", "left_anti"))
        now = votes.join(ready.withColumnRenamed("community", "ca"), "ca", "left_semi").join(moved, "cb", "left").withColumn("c", F.coalesce("to", "cb")).filter("c <> ca")
        per = now.groupBy("ca", "c").agg(F.sum("w").alias("w"))
        best = per.groupBy("ca").agg(F.max("w").alias("w")).join(per, ["ca", "w"]).groupBy("ca").agg(F.min("c").alias("to"))
        moved = checkpoint(moved.union(best.select("ca", "to")), instead_of=moved)
        waiting = checkpoint(waiting.join(ready, "community", "left_anti"), instead_of=waiting)
    return labels.join(moved, F.col("community") == F.col("cb"), "left").select("node", F.coalesce("to", "community").alias("community"))


def canonical(labels: DataFrame) -> DataFrame:
    """Communities named by their smallest member."""
    names = labels.groupBy("community").agg(F.min("node").alias("name"))
    return labels.join(names, "community").select("node", F.col("name").alias("community"))


def summaries(edges: DataFrame, labels: DataFrame, hubs: int = 3) -> DataFrame:
    """(community, members, internal_edges, hub_nodes, neighbours, neighbour_communities, modularity): hubs by in-degree inside the community."""
    a = labels.withColumnsRenamed({"node": "src", "community": "ca"})
    b = labels.withColumnsRenamed({"node": "dst", "community": "cb"})
    placed = checkpoint(edges.filter("src <> dst").select("src", "dst").join(a, "src").join(b, "dst"))  # read five times
    m = placed.agg(F.count("*").alias("m"))
    inner = placed.filter("ca = cb")
    internal = inner.groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("internal_edges"))
    degree = placed.select(F.explode(F.array("ca", "cb")).alias("community")).groupBy("community").agg(F.count("*").alias("d"))
    scored = labels.join(inner.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("hub_score")), "node", "left").fillna(0, ["hub_score"])
    own = W.partitionBy("community").orderBy(F.desc("hub_score"), "node")
    top = scored.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= hubs).groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]).alias("hub_nodes"))
    out = placed.filter("ca <> cb")
    near = out.select(F.col("ca").alias("community"), F.col("cb").alias("n")).union(out.select("cb", "ca")).distinct().groupBy("community").agg(F.sort_array(F.collect_list("n")).alias("neighbour_communities"))
    members = labels.groupBy("community").agg(F.count("*").alias("members"))
    joined = members.join(internal, "community", "left").join(degree, "community", "left").join(top, "community").join(near, "community", "left").join(F.broadcast(m)).fillna(0, ["internal_edges", "d"])
    term = F.when(F.col("m") > 0, F.col("internal_edges") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).otherwise(0.0)
    near_names = F.coalesce("neighbour_communities", F.array().cast(joined.schema["neighbour_communities"].dataType))
    return joined.select("community", "members", "internal_edges", "hub_nodes", F.size(near_names).cast("long").alias("neighbours"), near_names.alias("neighbour_communities"), term.alias("modularity"))


def between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src_community, dst_community, n): edges between communities."""
    a = labels.withColumnsRenamed({"node": "src", "community": "src_community"})
    b = labels.withColumnsRenamed({"node": "dst", "community": "dst_community"})
    return edges.join(a, "src").join(b, "dst").filter("src_community <> dst_community").groupBy("src_community", "dst_community").agg(F.count("*").alias("n"))


def community_counts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: communities, those of a single member, edges inside communities and between them."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("n")).agg(F.count("*").alias("communities"), F.count_if(F.col("n") == 1).alias("singletons"))
    a, b = labels.toDF("src", "ca"), labels.toDF("dst", "cb")
    placed = edges.join(a, "src").join(b, "dst").agg(F.count_if(F.col("ca") == F.col("cb")).alias("internal"), F.count_if(F.col("ca") != F.col("cb")).alias("external"))
    return sizes.join(F.broadcast(placed))


def lookup(labels: DataFrame, summary: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, community, members, hub_nodes) of the nodes asked for (node); null for a node of no community."""
    return nodes.select("node").distinct().join(labels, "node", "left").join(summary.select("community", "members", "hub_nodes"), "community", "left").select("node", "community", "members", "hub_nodes")
