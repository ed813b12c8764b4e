"""Document graphs: node and edge merging, aliases, annotation links, the linked view of documents and code, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions import text as T
from loomspark.sources.tables import checkpoint


def merge_nodes(rows: DataFrame) -> DataFrame:
    """One node for each (cluster_id, id) of rows (.., ord, node_type, display_name, attributes map, doc_id).

    The first display name stays, later attributes win key by key, documents are listed once in order.
    """
    keys = ["cluster_id", "id"]
    base = rows.groupBy(*keys).agg(F.min_by("node_type", "ord").alias("node_type"), F.min_by("display_name", "ord").alias("display_name"))
    pairs = rows.select(*keys, "ord", F.explode("attributes").alias("k", "v")).groupBy(*keys, "k").agg(F.max_by("v", "ord").alias("v"))
    attributes = pairs.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    docs = rows.groupBy(*keys, "doc_id").agg(F.min("ord").alias("ord")).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "doc_id"))), lambda x: x["doc_id"]).alias("documents"))
    return base.join(attributes, keys, "left").join(docs, keys)


def project_edges(assertions: DataFrame) -> DataFrame:
    """One edge for each (subject, object, edge_type, edge_key): detailed design decides count and confidence."""
    keys = ["subject", "object", "edge_type", "edge_key"]
    value = F.coalesce(F.max_by("value", F.when((F.col("side") == "dd") & F.col("value").isNotNull(), F.col("id"))), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("id"))))
    confidence = F.when(F.bool_or(F.col("side") == "dd"), "authoritative").otherwise(F.min_by("confidence", "id"))
    return assertions.groupBy(*keys).agg(value.alias("value"), confidence.alias("confidence"), F.sort_array(F.collect_list("id")).alias("evidence"))


def alias_map(rows: DataFrame) -> DataFrame:
    """(alias, dsn): the last row of an alias wins."""
    return rows.groupBy(F.upper("alias").alias("alias")).agg(F.max_by("dsn", "ord").alias("dsn"))


def legacy_symbol_edges(edges: DataFrame) -> DataFrame:
    """File-level facts as symbol edges: internal ones with a target symbol, the first confidence and method, all lines."""
    kept = edges.filter("dst_symbol is not null and not is_external")
    return kept.groupBy("src_symbol", "dst_symbol", "edge_type").agg(F.min_by("confidence_score", "ord").alias("confidence_score"), F.min_by("resolution_method", "ord").alias("resolution_method"), F.sort_array(F.collect_set("line")).alias("lines"))


#: Pairs of a note and an entity that a task tells apart.
PAIRS_A_TASK = 1 << 21


def annotation_edges(notes: DataFrame, entities: DataFrame, pairs_a_task: int = PAIRS_A_TASK) -> DataFrame:
    """(note_id, entity_id): notes (note_id, text) that hold an entity's name as a word, not their own.

    A pair comes up once for each shared name.  Pairs are counted by word first and then dealt to as many tasks as they need before repeats
    go, so that no task holds the pairs of all notes that it has read.
    """
    words = notes.repartition("note_id").select("note_id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit("([A-Z0-9_.-]*[A-Z0-9_])"), F.lit(1)))).alias("word"))
    names = checkpoint(entities.select("entity_id", F.upper("name").alias("word")).distinct())
    words = checkpoint(words.join(names.select("word").distinct(), "word", "left_semi"))
    sizes = names.groupBy("word").agg(F.count("*").alias("n"))
    pairs = words.groupBy("word").agg(F.count("*").alias("m")).join(sizes, "word").agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
    tasks = -(-pairs // pairs_a_task) or 1
    made = words.join(names, "word").filter("note_id <> entity_id").select("note_id", "entity_id")
    return made.repartition(tasks, "note_id", "entity_id").distinct()


def ancestors(bases: DataFrame, most: int = 20) -> DataFrame:
    """(class, ancestor, depth) over (class, base), at most 20 steps, each ancestor at its least depth."""
    from loomspark.operators.graph import hops

    seeds = bases.select(F.col("class").alias("node")).distinct()
    found = hops(bases.select(F.col("class").alias("src"), F.col("base").alias("dst")), seeds, most, include_seeds=False)
    return found.select(F.col("seed").alias("class"), F.col("node").alias("ancestor"), F.col("hop").alias("depth"))


def resolve_method(calls: DataFrame, methods: DataFrame, bases: DataFrame) -> DataFrame:
    """(call_id, owner): the class that defines a called method, the class itself or its nearest ancestor (ties by name)."""
    chain = ancestors(bases).unionByName(calls.select("class", F.col("class").alias("ancestor"), F.lit(0).alias("depth")).distinct())
    tried = calls.join(chain, "class").join(methods.select(F.col("class").alias("ancestor"), "method"), ["ancestor", "method"])
    best = tried.groupBy("call_id").agg(F.min(F.struct("depth", "ancestor")).alias("b"))
    return calls.select("call_id").join(best, "call_id", "left").select("call_id", F.col("b.ancestor").alias("owner"))


def linked_graph(doc_nodes: DataFrame, code_nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of both layers and the edges inside the scope, which is the documents' nodes and what is one step from them.

    Nodes: (key, node_type, in_doc, in_code, verdict); types that code cannot show are not assessed.
    """
    d = doc_nodes.select("key", "node_type").distinct().withColumn("in_doc", F.lit(True))
    c = code_nodes.select("key", F.col("node_type").alias("code_type")).distinct().withColumn("in_code", F.lit(True))
    both = d.join(c, "key", "full_outer")
    near = edges.join(d.select(F.col("key").alias("src")), "src", "left_semi").select(F.col("dst").alias("key")).union(edges.join(d.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src")))
    scope = d.select("key").union(near).distinct()
    verdict = F.when(~F.coalesce("node_type", "code_type").isin("program", "job", "step", "dd", "dataset"), "not_assessed").when(F.col("in_doc").isNull(), "undocumented").when(F.col("in_code").isNull(), "missing").otherwise("matched")
    nodes = both.join(scope, "key", "left_semi").select("key", F.coalesce("node_type", "code_type").alias("node_type"), F.coalesce("in_doc", F.lit(False)).alias("in_doc"), F.coalesce("in_code", F.lit(False)).alias("in_code"), verdict.alias("verdict"))
    inner = edges.join(nodes.select(F.col("key").alias("src")), "src", "left_semi").join(nodes.select(F.col("key").alias("dst")), "dst", "left_semi")
    return nodes, inner


def risk_summary(cone: DataFrame, labels: DataFrame, high: int = 1) -> DataFrame:
    """For each seed of (seed, node, hop): files, files by hop, files within `high` hops, communities reached."""
    c = cone.filter("hop > 0").join(labels, "node", "left")
    by_hop = c.groupBy("seed", "hop").agg(F.count("*").alias("n")).groupBy("seed").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("hop", "n")))).alias("by_hop"))
    total = c.groupBy("seed").agg(F.count("*").alias("total"), F.count_if(F.col("hop") <= high).alias("high_risk"), F.count_distinct("community").alias("communities"))
    return total.join(by_hop, "seed")


def affected_communities(cone: DataFrame, labels: DataFrame, degrees: DataFrame, hubs: int = 5) -> DataFrame:
    """(seed, community, n, hubs): the communities that a cone touches and their best-linked members in it."""
    c = cone.join(labels, "node").join(degrees.select("node", "score"), "node", "left").fillna(0, ["score"])
    own = W.partitionBy("seed", "community").orderBy(F.desc("score"), "node")
    top = c.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= hubs).groupBy("seed", "community").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]).alias("hubs"))
    return c.groupBy("seed", "community").agg(F.count("*").alias("n")).join(top, ["seed", "community"])


def barrels(chunks: DataFrame, share: float = 0.8) -> DataFrame:
    """Chunks whose lines are mostly re-exports or imports."""
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    hits = F.filter(lines, lambda x: F.rlike(x, F.lit(r"^(export\s.*from\s|export\s*\*|from\s+\S+\s+import\s|import\s)")))
    return chunks.withColumn("is_barrel", (F.size(lines) > 0) & (F.size(hits) >= share * F.size(lines)))


def symbol_keys(symbols: DataFrame) -> DataFrame:
    """(key, fqn): each symbol under its name, parent.name and full name, in lower case."""
    fqn = F.concat(F.col("rel_path"), F.lit("::"), F.concat_ws(".", "parent_name", "name"))
    keys = F.array_distinct(F.transform(F.array(F.col("name"), F.concat_ws(".", "parent_name", "name"), fqn), lambda x: F.lower(x)))
    return symbols.select(F.explode(keys).alias("key"), fqn.alias("fqn"))


def confident_neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(rel_path, confidence): distinct targets of the seed files' symbol edges outside their own file."""
    rows = edges.withColumns({"f": T.symbol_file(F.col("src")), "rel_path": T.symbol_file(F.col("dst"))}).filter("f <> rel_path")
    return rows.join(seeds.select(F.col("rel_path").alias("f")).distinct(), "f", "left_semi").select("src", "dst", "rel_path", "confidence").distinct().select("rel_path", "confidence")
