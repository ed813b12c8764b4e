"""Graph analytics over edge tables (src, dst, ...): degrees, hops, cones, chains, paths, cycles.

Traversals advance one hop at a time: the frontier is joined with the edges, nodes already seen are
anti-joined away, and each hop is checkpointed, so that plans stay short and a lost executor costs one hop.
Only counts reach the driver.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions import text as T
from loomspark.operators.communities import _numbered
from loomspark.sources.tables import checkpoint


def degrees(edges: DataFrame) -> DataFrame:
    """(node, indegree, outdegree, score): repeated edges count; score is 3 * in + out."""
    both = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    own = both.groupBy("node").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))
    return own.withColumn("score", 3 * F.col("indegree") + F.col("outdegree"))


def central(edges: DataFrame, k: int = 30) -> DataFrame:
    """The k most central nodes with their rank from 0."""
    top = degrees(edges).orderBy(F.desc("score"), F.desc("indegree"), "node").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.desc("indegree"), "node")) - 1)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).filter("src <> dst").distinct()


def hops(edges: DataFrame, seeds: DataFrame, most: int, include_seeds: bool = True, quota: int | None = None) -> DataFrame:
    """(seed, node, hop): the least number of edges from each seed to each node within `most`, along src to dst.

    With a quota a seed gets so many nodes (itself included), nearest first, ties by name: a hop adds no more than are
    missing, and a seed that has them all goes no further.
    """
    steps = checkpoint(edges.select("src", "dst").distinct())
    seen = checkpoint(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop")).distinct())
    frontier = seen
    for hop in range(1, most + 1):
        reached = frontier.join(steps, frontier["node"] == steps["src"]).select("seed", F.col("dst").alias("node")).distinct()
        reached = reached.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        if quota is not None:
            missing = seen.groupBy("seed").agg((quota - F.count("*")).alias("_missing")).filter("_missing > 0")
            own = W.partitionBy("seed").orderBy("node")
            # the rank's own bound lets each task keep a quota's worth before the shuffle
            ranked = reached.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= quota)
            reached = ranked.join(missing, "seed").filter("_r <= _missing").drop("_r", "_missing")
        frontier = checkpoint(reached)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if quota is not None and hop < most:
            full = seen.groupBy("seed").count().filter(F.col("count") >= quota)
            frontier = frontier.join(full, "seed", "left_anti")
    return seen if include_seeds else seen.filter("hop > 0")


def neighbourhood(edges: DataFrame, seeds: DataFrame, most: int, limit: int = 300) -> DataFrame:
    """(seed, node, hop): undirected, at most `limit` nodes of each seed, nearest first, ties by name."""
    return hops(undirected(edges), seeds, max(1, min(4, most)), quota=limit)


def neighbourhood_edges(edges: DataFrame, nodes: DataFrame, most: int, limit: int = 300) -> DataFrame:
    """(seed, src, dst, ...): of each seed's nodes (seed, node, hop) the edges between two of them of which one was expanded (hop below `most`).

    At most `limit` a seed, repeated edges kept: those nearest to the seed first, then by name.
    """
    near = checkpoint(nodes.select("seed", "node", "hop"))
    names = _numbered(near.select(F.col("seed").alias("name")).distinct()).select(F.col("name").alias("seed"), F.col("number").cast("int").alias("_number"))
    # seeds are numbers, and a pair of nodes meets all seeds of both ends at once instead of one row a seed
    rings = checkpoint(near.join(names, "seed").groupBy("node", "hop").agg(F.collect_list("_number").alias("seeds")))
    end = lambda x, hop, seeds: rings.select(F.col("node").alias(x), F.col("hop").alias(hop), F.col("seeds").alias(seeds))
    both = edges.select("src", "dst").distinct().join(end("src", "_a", "_s"), "src").join(end("dst", "_b", "_t"), "dst").filter(F.least("_a", "_b") < most)
    inside = both.select("src", "dst", F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"), F.explode(F.array_intersect("_s", "_t")).alias("_number"))
    # each pair has an edge at least, so that the first pairs hold the first edges
    by_pair = W.partitionBy("_number").orderBy("_a", "_b", "src", "dst")
    first = inside.withColumn("_r", F.row_number().over(by_pair)).filter(F.col("_r") <= limit).drop("_r")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    own = W.partitionBy("_number").orderBy("_a", "_b", "src", "dst", *rest)
    kept = edges.join(first, ["src", "dst"]).withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= limit)
    return kept.join(names, "_number").select("seed", "src", "dst", *rest)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def impact_cone(edges: DataFrame, seeds: DataFrame, most: int, limit: int = 500) -> DataFrame:
    """(seed, node, hop): nodes around each seed in either direction; hop counts only steps against the edges (else null)."""
    once = checkpoint(edges.select("src", "dst").distinct())
    kept = hops(undirected(once), seeds, max(1, min(4, most)), quota=limit).select("seed", "node")
    back = hops(reverse(once), seeds, max(1, min(4, most)))
    return kept.join(back, ["seed", "node"], "left")


#: Numbers of seeds that one group of a cone's hop may bring together before its node is dealt to several groups.
SEEDS_A_GROUP = 1 << 22


def _dealt(rows: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """rows (node, came, old) with a part: 0, or for heavy nodes (node, parts) a seed's number modulo the node's parts."""
    if heavy is None:
        return rows.withColumn("part", F.lit(0))
    k = F.col("parts")
    split = lambda x: F.filter(x, lambda s: s % k == F.col("part"))
    dealt = rows.join(heavy, "node", "left").withColumn("part", F.explode(F.when(k.isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), k - 1))))
    return dealt.select("node", *(F.when(k.isNull(), F.col(x)).otherwise(split(F.col(x))).alias(x) for x in ("came", "old")), "part")


def reverse_cone(edges: DataFrame, seeds: DataFrame, most: int, group: int = SEEDS_A_GROUP) -> DataFrame:
    """(seed, node, hop): what depends on each seed; the seed itself counts when a cycle leads back to it.

    Seeds are numbered, and all hops go together: a row is a node with the seeds that reach it first at one hop, so that an edge carries
    its seeds at once.  A node with many edges and seeds is dealt to parts by seed, so that no group outgrows `group` by much.
    """
    steps = checkpoint(reverse(edges).distinct())
    names = _numbered(seeds.filter("node is not null").select(F.col("node").alias("name")).distinct()).select(F.col("name").alias("seed"), F.col("number").cast("int").alias("number"))
    sizes = steps.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    widest = sizes.agg(F.max("n")).first()[0] or 0
    frontier, seen = names.select(F.col("seed").alias("node"), F.array("number").alias("seeds")), None
    none = F.lit(None).cast("array<int>")
    for hop in range(1, most + 1):
        rows = frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node"), F.col("seeds").alias("came"), none.alias("old"))
        if seen is not None:
            rows = rows.unionByName(seen.select("node", none.alias("came"), F.col("seeds").alias("old")))
        longest = 1 if seen is None else frontier.agg(F.max(F.size("seeds"))).first()[0]
        heavy = None
        if widest * longest > group:
            heavy = checkpoint(sizes.filter(F.col("n") * longest > group).select("node", F.ceil(F.col("n") * longest / group).cast("int").alias("parts")))
        both = _dealt(rows, heavy).groupBy("node", "part").agg(F.flatten(F.collect_list("came")).alias("came"), F.flatten(F.collect_list("old")).alias("old"))
        reached = both.select("node", F.array_except("came", "old").alias("seeds"), F.lit(hop).alias("hop")).filter(F.size("seeds") > 0)
        frontier = reached if hop == most and hop > 1 else checkpoint(reached)
        seen = frontier if seen is None else seen.unionByName(frontier)
        if hop < most and frontier.isEmpty():
            break
    return seen.select("node", "hop", F.explode("seeds").alias("number")).join(names, "number").select("seed", "node", "hop")


def symbol_cone(edges: DataFrame, seeds: DataFrame, most: int = 6, min_confidence: float = 0.7, kinds: list[str] | None = None, stop_above: int = 500) -> DataFrame:
    """Reverse cone over symbols along confident edges; a seed with more than `stop_above` nodes goes no further."""
    kept = edges.filter(F.col("confidence") >= min_confidence)
    if kinds:
        kept = kept.filter(F.col("edge_type").isin(kinds))
    steps = checkpoint(reverse(kept).distinct())
    seen = frontier = checkpoint(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop")).distinct())
    for hop in range(1, max(1, min(6, most)) + 1):
        open_ = seen.groupBy("seed").count().filter(F.col("count") <= stop_above).select("seed")
        reached = frontier.join(open_, "seed", "left_semi").join(steps, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = checkpoint(reached.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 10) -> DataFrame:
    """(src, dst, path): the first shortest path by node names of each pair; [] for a node to itself, null if none."""
    steps = checkpoint(edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b")).distinct())
    seen = frontier = checkpoint(pairs.select(F.col("src").alias("seed")).distinct().select("seed", F.col("seed").alias("node"), F.array("seed").alias("path")))
    for _ in range(most):
        grown = frontier.join(steps, F.col("node") == F.col("_a")).select("seed", F.col("_b").alias("node"), F.array_append("path", F.col("_b")).alias("path"))
        new = grown.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").groupBy("seed", "node").agg(F.min("path").alias("path"))
        frontier = checkpoint(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = pairs.join(seen.select(F.col("seed").alias("src"), F.col("node").alias("dst"), "path"), ["src", "dst"], "left")
    return found.select("src", "dst", F.when(F.col("src") == F.col("dst"), F.array().cast(found.schema["path"].dataType)).otherwise(F.col("path")).alias("path"))


def callees(edges: DataFrame, files: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Edges whose source symbol lies in one of the files (file): an equi-join on the symbol's file."""
    own = edges.filter(F.col("confidence") >= min_confidence).withColumn("file", T.symbol_file(F.col("src")))
    return own.join(files.select("file").distinct(), "file", "left_semi").drop("file")


def callers(edges: DataFrame, files: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Edges whose target symbol lies in one of the files."""
    own = edges.filter(F.col("confidence") >= min_confidence).withColumn("file", T.symbol_file(F.col("dst")))
    return own.join(files.select("file").distinct(), "file", "left_semi").drop("file")


def call_chain(edges: DataFrame, seeds: DataFrame, most: int = 4, stop_above: int = 30, forward: bool = True) -> DataFrame:
    """(seed, file, step, path_confidence, n_symbols) over file-level calls (src_file, dst_file, symbol, confidence).

    Each file joins at its first hop; a chain stops once it holds more than `stop_above` files.  Confidence follows
    the listing order (hop, file): each entry multiplies the one listed before it by its own best hop.
    """
    a, b = ("src_file", "dst_file") if forward else ("dst_file", "src_file")
    steps = checkpoint(edges.filter(f"{a} <> {b}").groupBy(F.col(a).alias("from"), F.col(b).alias("to")).agg(F.max("confidence").alias("c"), F.collect_set("symbol").alias("symbols")))
    seen = frontier = checkpoint(seeds.select(F.col("node").alias("seed"), F.col("node").alias("file")).distinct().withColumns({"step": F.lit(0), "best": F.lit(1.0), "symbols": F.array().cast("array<string>")}))
    for hop in range(1, most + 1):
        open_ = seen.groupBy("seed").count().filter(F.col("count") <= stop_above).select("seed")
        reached = frontier.join(open_, "seed", "left_semi").join(steps, F.col("file") == F.col("from")).select("seed", F.col("to").alias("file"), "c", steps["symbols"])
        new = reached.groupBy("seed", "file").agg(F.lit(hop).alias("step"), F.max("c").alias("best"), F.array_distinct(F.flatten(F.collect_list("symbols"))).alias("symbols"))
        frontier = checkpoint(new.join(seen, ["seed", "file"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    order = W.partitionBy("seed").orderBy("step", "file").rowsBetween(W.unboundedPreceding, W.currentRow)
    return seen.select("seed", "file", "step", F.product("best").over(order).alias("path_confidence"), F.size("symbols").alias("n_symbols"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of the nodes on cycles; component is the cycle's smallest node.

    Rounds of forward colouring until no edge is left: nodes without an edge in or out are trimmed; every node
    takes the first node that reaches it, in an order by hash that is new in each round; going back from each
    such node inside its colour gives one component, which leaves, as do edges between colours.  In a random
    order a chain of cycles falls into parts each round, however they are named, so that rounds stay few.
    """
    live = checkpoint(edges.filter("src <> dst").select("src", "dst").distinct())
    found = None
    for turn in itertools.count():
        while True:  # trim
            sources, targets = live.select(F.col("src").alias("n")).distinct(), live.select(F.col("dst").alias("n")).distinct()
            core = checkpoint(live.join(targets, F.col("src") == F.col("n"), "left_semi").join(sources.withColumnRenamed("n", "m"), F.col("dst") == F.col("m"), "left_semi"))
            done = core.count() == live.count()
            live = core
            if done:
                break
        if live.isEmpty():
            break
        colour = checkpoint(live.select(F.col("src").alias("node")).union(live.select("dst")).distinct().withColumn("colour", F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node")))
        table = None
        while True:
            came = live.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("came"))
            after = table = checkpoint(colour.join(came, "node", "left").select("node", "colour", F.least("colour", F.coalesce("came", "colour")).alias("next")), instead_of=table)
            still = after.filter("colour <> next").isEmpty()
            colour = after.select("node", F.col("next").alias("colour"))
            if still:
                break
        inner = live.join(colour.withColumnsRenamed({"node": "src", "colour": "a"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "b"}), "dst").filter("a = b")
        inner = checkpoint(inner.select(F.col("src").alias("before"), F.col("dst").alias("node"), F.col("a").alias("colour")))
        back = frontier = checkpoint(colour.filter("node = colour.node"))
        while not frontier.isEmpty():
            step = frontier.join(inner, ["node", "colour"]).select(F.col("before").alias("node"), "colour").distinct()
            frontier = checkpoint(step.join(back, ["node", "colour"], "left_anti"))
            back = back.unionByName(frontier)
        back = checkpoint(back.select("node", F.col("colour.node").alias("root")))
        found = back if found is None else found.unionByName(back)
        live = inner.select(F.col("before").alias("src"), F.col("node").alias("dst"))
        live = checkpoint(live.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if found is None:
        found = edges.select(F.col("src").alias("node"), F.col("src").alias("root")).limit(0)
    sizes = found.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("size")).filter("size > 1")
    return found.join(sizes, "root").select("node", "component", "size")
