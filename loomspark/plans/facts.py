"""Paths, names, relations, checks and builds over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions import paths as P
from loomspark.functions import text as T
from loomspark.operators import bm25, communities, documents, graph, ranking, reconcile, relations, search
from loomspark.plans import graphs, retrieval
from loomspark.sources.tables import checkpoint, read
from loomspark.streaming import incremental

DIRS = ["", "src/", "src/latest/", "docs/", "node_modules/x/", "a/bin/", "a/routes/", ".github/", "db/migrations/", "infra/", "venv/", "tests/"]
NAMES = ["main.py", "__init__.py", "index.ts", "router_a.js", "GEN.BD-X.md", "GEN.DD.COBOL-P.md", "GEN.DD.JCL-J.md", "keyboard.rs", "a.min.js", "logo.PNG", "CMakeLists.txt", "run", "b.YAML", "x.lock", "Dockerfile", "notes"]


def _at(values: list[str], k) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's path tells when documents are files of a code tree."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(_at(DIRS, F.col("doc_id")), _at(NAMES, F.floor(F.col("doc_id") / 12))).alias("rel_path"), F.when(F.col("lang") == "en", "#!/usr/bin/env python").otherwise("text").alias("line"))
    p = F.col("rel_path")
    known = P.with_language(docs, "rel_path", F.col("line"))
    return known.select("doc_id", "rel_path", "language", P.category(p).alias("category"), P.ignored(p).alias("ignored"), P.is_test_path(p).alias("is_test"), P.is_entrypoint(p).alias("entrypoint"), P.is_init_file(p).alias("is_init"), P.document_kind(P.file_name(p), strict=False).alias("kind"))


def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes: some begin with a NUL, some are cut inside; which are binary, and the first 200 bytes of the others as text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    content = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(b"\x00"), F.col("b"))).otherwise(F.col("b"))
    made = docs.select("doc_id", content.alias("content")).withColumn("binary", P.is_binary(F.col("content")))
    return made.select("doc_id", "binary", F.octet_length("content").alias("size_bytes"), F.when(~F.col("binary"), P.lenient_text(F.col("content"), 200)).alias("head"))


def name_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers, clauses, references and node names made of every part's columns."""
    part = read(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    camel = F.concat(words[0], F.upper(F.substring(words[1], 1, 1)), F.substring(words[1], 2, 99))
    token = F.when(F.col("p_partkey") % 2 == 0, camel).otherwise(F.array_join(words, "_"))
    dcb = F.concat(F.lit("(RECFM=FB,LRECL="), F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, ",BLKSIZE=800)").otherwise(")"))
    span = F.concat(F.upper(words[0]), F.lit(".CBL L"), F.col("p_size"), F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("-"), F.col("p_size") + 5)).otherwise(""))
    disp = F.when(F.col("p_type") == "ECONOMY", "(NEW,CATLG)").when(F.col("p_type") == "SMALL", "SHR").otherwise("")
    kind = _at(["program", "step", "copybook", "field", "dataset", "br"], F.col("p_partkey"))
    made = part.select(
        "p_partkey", T.split_identifier(token).alias("terms"), T.dcb(dcb).alias("dcb"), T.source_span(span).alias("span"), T.call_sites(F.concat(F.lit("L0"), F.col("p_size"), F.lit(" x, L12, y"))).alias("sites"),
        T.dd_mode(_at(["SORTOUT", "IN1", "STEPLIB", "DATA"], F.col("p_partkey")), disp).alias("mode"), relations.node_id(kind, F.concat("p_name", F.lit(".cpy"))).alias("node"), relations.quoted_name(F.concat("p_name", F.lit("&"), "p_brand")).alias("quoted"),
        relations.artifact_name(F.concat(F.lit("GEN.DD.COBOL-"), words[0], F.lit(".report.md"))).alias("artifact"), T.normalize(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \n ")), F.lit(" "))).alias("normal"), T.chunk_size(F.when(F.col("p_size") < 25, "docs").otherwise("source"), F.when(F.col("p_size") > 40, "python")).alias("chunk_size"),
    )
    return made.select("p_partkey", F.array_join("terms", " ").alias("terms"), F.concat_ws("/", "dcb.lrecl", "dcb.blksize", "dcb.recfm").alias("dcb"), F.concat_ws("/", "span.source_artifact", "span.line_start", "span.line_end").alias("span"), F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"), "mode.mode", "mode.definitive", "node", "quoted", "artifact", "normal", F.col("chunk_size").cast("int").alias("chunk_size"))


def _cone(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two hops against the edges from every seed part, communities (brands), and degrees."""
    e = checkpoint(graphs.file_edges(spark, sf_dir))
    cone = graph.reverse_cone(e, graphs.seeds(spark, sf_dir), 2)
    labels = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_brand").alias("community"))
    return cone, labels, graph.degrees(e)


def risk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each seed's change reaches: in all, by hop, at high risk, and their communities."""
    cone, labels, _ = _cone(spark, sf_dir)
    out = documents.risk_summary(cone, labels)
    by_hop = F.array_join(F.transform(F.map_entries("by_hop"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return out.select("seed", "total", "high_risk", "communities", by_hop.alias("by_hop"))


def affected_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities that each seed's change reaches, and their best-linked members in reach."""
    cone, labels, degrees = _cone(spark, sf_dir)
    return documents.affected_communities(cone, labels, degrees).select("seed", "community", "n", F.array_join("hubs", ",").alias("hubs"))


def impact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The impact of every file that any seed reaches, at its least hop."""
    cone, labels, degrees = _cone(spark, sf_dir)
    hop = cone.groupBy("node").agg(F.min("hop").alias("hop"))
    top = F.broadcast(graph.central(graphs.file_edges(spark, sf_dir)).select("node", "rank"))  # 30 rows
    own = bm25.small(labels.join(graphs.seeds(spark, sf_dir), "node", "left_semi").select("community").distinct().withColumn("seeded", F.lit(True)))
    joined = hop.join(top, "node", "left").join(labels, "node").join(own, "community", "left").join(degrees.select("node", "score"), "node")
    score = T.impact_score(F.col("hop"), F.col("rank"), F.coalesce("seeded", F.lit(False)), F.lit(False), F.col("hop") == 1, F.col("score") / 10.0)
    return joined.select("node", "hop", F.round(score, 6).alias("impact"))


def resolution_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the targets of edges, for every part and resolution method."""
    part = read(spark, sf_dir, "part")
    dst = F.concat(_at(["src/", "__external__/copybook/", "__unresolved__/", "__external__/"], F.col("p_size")), _at(["DFHAID", "ceeloc", "MQOPEN", "abend&x", "plain"], F.col("p_partkey")), F.lit(".cpy"))
    method = _at(["import_statement", "external_utility", "symbolic_dsn", "system_copybook", "copybook_not_found", "external_runtime"], F.floor(F.col("p_partkey") / 5))
    made = part.select(dst.alias("dst"), method.alias("method"))
    return made.groupBy(T.resolution_class(F.col("dst"), F.col("method"), relations.SYSTEM_COPYBOOKS, ["ABEND"]).alias("class"), "method").agg(F.count("*").alias("n"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lines as facts: customers are programs and jobs, orders steps, lines calls and data definitions."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    null = F.lit(None).cast("string")
    fact = lambda kind, key, parent, path, name, value, line: [F.lit(kind).alias("fact_type"), key.alias("semantic_key"), parent.alias("parent_key"), path.alias("rel_path"), name.alias("name"), value.alias("value"), line.cast("int").alias("line")]
    step = F.concat(F.lit("step/J"), F.col("o_custkey"), F.lit(".S"), F.col("o_orderkey"))
    c = F.concat(F.lit("P"), F.col("o_custkey"))
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    path = F.concat(F.col("o_custkey"), F.lit(".cbl"))
    return (
        orders.filter("o_orderstatus = 'P'").select(*fact("program", F.concat(F.lit("program/"), c), null, path, c, null, F.lit(1)))
        .unionByName(orders.select(*fact("step", step, F.concat(F.lit("job/J"), F.col("o_custkey")), path, null, F.concat(F.lit(" p"), F.col("o_orderkey") % 900, F.lit(" ")), F.lit(2))))
        .unionByName(both.select(*fact("call", F.concat(F.lit("call/"), c, F.lit(".MAIN.P"), F.col("l_partkey")), F.concat(F.lit("program/"), c), path, F.when(F.col("l_linenumber") == 1, F.concat(F.lit("P"), F.col("l_suppkey"))), null, F.col("l_linenumber"))))
        .unionByName(both.filter("l_returnflag = 'R'").select(*fact("dd", F.concat(F.replace(step, F.lit("step/"), F.lit("dd/")), F.lit(".D"), F.col("l_linenumber")), step, path, null, null, F.col("l_linenumber"))))
    )


def code_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of the facts inside a scope of customers, by predicate and object: their number and lines."""
    customers = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    programs, jobs = customers.select(F.concat(F.lit("P"), "c_custkey").alias("name")), customers.select(F.concat(F.lit("J"), "c_custkey").alias("name"))
    copies = read(spark, sf_dir, "orders").select(F.concat(F.lit("a.cbl::p"), "o_custkey").alias("src"), F.concat(F.lit("b.cpy::c"), F.col("o_orderkey") % 50).alias("dst"))
    found = relations.code_relations(_facts(spark, sf_dir), copies, programs, jobs)
    return found.groupBy("predicate", "subject", "object").agg(F.count("*").alias("n"), F.min("occurrence").alias("first"), F.sum("line").alias("lines"))


def relation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as comparisons of customers' snapshots: bound, stale or unbound."""
    clusters = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cluster_id"), (F.col("o_custkey") + F.col("o_orderkey") % 2 * 1000000).alias("snapshot_id"), F.col("o_orderstatus").alias("fingerprint"))
    snapshots = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("snapshot_id"), F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("O").alias("fingerprint"))
    return relations.comparison_status(clusters, snapshots)


def field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of parts that suppliers' lines give otherwise: each difference once."""
    bd = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("part"), F.concat(F.lit("X("), F.col("p_size"), F.lit(")")).alias("value"))
    dd = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("part"), F.concat(F.lit("X("), F.col("l_quantity").cast("int"), F.lit(")")).alias("value"))
    dd = dd.groupBy("part", "id").agg(F.max("value").alias("value"))
    found = relations.field_differences(bd, dd, ["part"], "field_pic")
    twice = found.unionByName(found.withColumn("id", F.col("id") + 1))
    return relations.once(twice, reconcile.fingerprint(F.col("mismatch_type"), F.col("subject"), F.col("value"), F.col("dd_value"))).select("id", "subject", "value", "dd_value", "fingerprint")


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a document graph from line items: detailed design decides count and confidence."""
    lines = read(spark, sf_dir, "lineitem")
    rows = lines.select((F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("id"), F.when(F.col("l_returnflag") == "R", "dd").otherwise("bd").alias("side"), F.col("l_suppkey").alias("subject"), (F.col("l_partkey") % 50).alias("object"), F.lit("calls").alias("edge_type"), F.lit("").alias("edge_key"), F.when(F.col("l_discount") > 0.02, F.col("l_quantity").cast("int")).alias("value"), F.when(F.col("l_tax") > 0.03, "corroborating").otherwise("unverified").alias("confidence"))
    return documents.project_edges(rows).select("subject", "object", "value", "confidence", F.size("evidence").alias("n"))


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of clusters merged from events: the first name stays, later attributes win, documents are listed once."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("cluster_id"), F.concat(F.lit("dataset/"), F.col("user_id")).alias("id"), F.col("event_id").alias("ord"), F.lit("dataset").alias("node_type"), F.concat_ws("-", "event_type", "event_id").alias("display_name"), F.create_map(F.col("event_type"), F.col("value").cast("string")).alias("attributes"), F.col("event_type").alias("doc_id"))
    attributes = F.array_join(F.transform(F.map_entries("attributes"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return documents.merge_nodes(e).select("cluster_id", "id", "node_type", "display_name", attributes.alias("attributes"), F.array_join("documents", ",").alias("documents"))


def dataset_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each alias' last dataset: users as aliases of what they touched."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("alias"), F.concat_ws(".", "event_type", "event_id").alias("dsn"), F.col("event_id").alias("ord"))
    return documents.alias_map(e)


def linked_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that documents (suppliers) and code (parts of the lines) name, within one step of the documents' nodes."""
    lines = read(spark, sf_dir, "lineitem")
    key = lambda c, kind: F.concat(F.lit(f"{kind}/"), c)
    doc = read(spark, sf_dir, "supplier").filter("s_acctbal > 2000").select(key(F.col("s_suppkey"), "program").alias("key"), F.lit("program").alias("node_type")).unionByName(read(spark, sf_dir, "nation").select(key(F.col("n_name"), "actor").alias("key"), F.lit("actor").alias("node_type")))
    code = lines.filter("l_quantity > 49").select(key(F.col("l_suppkey"), "program").alias("key"), F.lit("program").alias("node_type")).unionByName(lines.select(key(F.col("l_partkey"), "dataset").alias("key"), F.lit("dataset").alias("node_type")))
    edges = lines.select(key(F.col("l_suppkey"), "program").alias("src"), key(F.col("l_partkey"), "dataset").alias("dst"))
    nodes, inner = documents.linked_graph(doc, code, edges)
    counts = inner.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("links"))
    return nodes.join(counts, "key", "left").select("key", "node_type", "in_doc", "in_code", "verdict", F.coalesce("links", F.lit(0)).alias("links"))


def not_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many linked nodes of each type have which verdict."""
    return linked_view(spark, sf_dir).groupBy("node_type", "verdict").agg(F.count("*").alias("n"))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: name and kind from their columns, files by supplier-like groups, a base for every third class."""
    part = read(spark, sf_dir, "part")
    path = F.concat(F.lit("f"), F.col("p_partkey") % 97, F.lit(".py"))
    name = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "class").when(F.col("p_partkey") % 3 == 1, "function").otherwise("interface")
    base = F.when(F.col("p_partkey") % 9 == 0, F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size") % 7 + 1))
    return part.select(F.concat(path, F.lit("::"), name, F.lit("#"), F.col("p_partkey")).alias("fqn"), path.alias("rel_path"), name.alias("name"), kind.alias("kind"), base.alias("base"), F.col("p_partkey").alias("line"), F.col("p_brand").alias("parent_name"))


def interface_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that name an interface as their base."""
    return relations.implementors(_symbols(spark, sf_dir))


def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols each key (name, parent.name, full name) leads to."""
    return documents.symbol_keys(_symbols(spark, sf_dir).select("rel_path", "name", "parent_name")).groupBy("key").agg(F.count("*").alias("n"), F.min("fqn").alias("first"))


def capped_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of line items, once each, at most 2,000 a file (a supplier)."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rel_path"), F.col("l_partkey").alias("name"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("line"))
    return relations.unique_symbols(lines).groupBy("rel_path").agg(F.count("*").alias("n"), F.max("line").alias("last"))


def fact_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered within their order by part modulo and within their flag."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rel_path"), (F.col("l_partkey") % 3).alias("semantic_key"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("parent_key"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 50 + F.col("l_quantity")).alias("id"))
    numbered = relations.occurrences(rows)
    return numbered.groupBy("rel_path", "semantic_key").agg(F.max("occurrence_ix").alias("last_ix"), F.max("ordinal").alias("last_ordinal"))


def copybook_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copybook names of orders' lines against those that a few parts define."""
    name = F.concat(_at(["A", "DFH", "B", "CEE"], F.col("l_partkey")), F.col("l_partkey") % 40)
    refs = read(spark, sf_dir, "lineitem").select(F.concat(F.col("l_suppkey"), F.lit(".cbl")).alias("src_path"), name.alias("name")).distinct()
    index = read(spark, sf_dir, "part").filter("p_size < 20").select(F.concat(_at(["A", "DFH", "B", "CEE"], F.col("p_partkey")), F.col("p_partkey") % 60 + 10).alias("name"), F.concat(F.lit("cpy/"), F.col("p_size"), F.lit(".cpy")).alias("path"))
    return relations.resolve_copybooks(refs, index)


def program_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that orders run against those that customers define: unique, ambiguous or missing."""
    refs = read(spark, sf_dir, "orders").select(F.concat(F.lit("j"), F.col("o_custkey"), F.lit(".jcl")).alias("src_path"), F.concat(F.lit("PG"), F.col("o_orderkey") % 500).alias("name")).distinct()
    index = read(spark, sf_dir, "customer").select(F.concat(F.lit("PG"), F.col("c_custkey") % 400).alias("name"), F.concat(F.lit("n"), F.floor(F.col("c_custkey") / 800), F.lit(".cbl")).alias("path"))
    return reconcile.resolve_unique(refs, index, "jcl_exec_statement", "ambiguous_program_id", "program_not_in_snapshot", "program")


def relative_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative imports of parts to the first ending that a file has."""
    part = read(spark, sf_dir, "part")
    targets = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("m/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size") % 12).alias("base"))
    files = part.select(F.concat(F.lit("m/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size") % 20, _at(["", ".py", ".tsx", "/index.js", ".md"], F.col("p_partkey"))).alias("path"))
    return reconcile.resolve_relative(targets, files)


def call_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that defines each called method, along bases: customers inherit from a customer of half their number."""
    c = read(spark, sf_dir, "customer")
    bases = c.filter("c_custkey > 0").select(F.col("c_custkey").alias("class"), F.floor(F.col("c_custkey") / 2).alias("base"))
    methods = c.select(F.col("c_custkey").alias("class"), (F.col("c_nationkey") % 7).alias("method"))
    calls = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("class"), (F.col("o_orderkey") % 9).cast("int").alias("method"))
    return documents.resolve_method(calls, methods, bases)


def annotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names that name nations or words as entities: links of notes."""
    notes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("note_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    entities = read(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("entity_id"), F.element_at(F.split("p_name", " "), (F.col("p_partkey") % 2 + 1).cast("int")).alias("name")).distinct()
    return documents.annotation_edges(notes, entities)


def legacy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-level facts of lines as symbol edges: first confidence, all lines."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src_symbol"), F.when(F.col("l_tax") > 0, F.col("l_partkey")).alias("dst_symbol"), F.col("l_returnflag").alias("edge_type"), (F.col("l_linestatus") == "O").alias("is_external"), F.col("l_discount").alias("confidence_score"), F.concat(F.lit("m"), F.col("l_discount")).alias("resolution_method"), F.col("l_linenumber").alias("line"), F.struct("l_orderkey", "l_linenumber", "l_discount", "l_quantity").alias("ord"))
    made = documents.legacy_symbol_edges(rows)
    return made.select("src_symbol", "dst_symbol", "edge_type", F.round("confidence_score", 6).alias("confidence_score"), F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose hash a cache of two languages lacks or has otherwise."""
    docs = read(spark, sf_dir, "documents").select("lang", "source", F.col("doc_id").alias("rel_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    cache = docs.filter("lang in ('en', 'de')").withColumn("sha", F.when(F.col("source") == "src1", F.lit("old")).otherwise(F.col("sha")))
    return incremental.changed_files(docs.select("rel_path", "sha"), cache)


def term_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether term statistics are built anew, from chunks now and before, for three versions."""
    now = read(spark, sf_dir, "documents").select(F.col("source").alias("rel_path"), F.col("doc_id").alias("chunk_index"), F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"))
    changed = now.withColumn("content_hash", F.when(F.col("chunk_index") % 50 == 0, "x").otherwise(F.col("content_hash")))
    cases = [("same", now, 7), ("fiftieth", now, 50), ("changed", changed, 7), ("none", now.limit(0), 7)]
    out = None
    for name, before, version in cases:
        row = relations.term_decision(now, before, version).withColumn("case", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def builds_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as inputs: which are to be built again after their orders changed."""
    c = read(spark, sf_dir, "customer")
    wanted = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("fingerprint"), (F.col("c_nationkey") % 2).cast("int").alias("parser_version"))
    built = c.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "old").otherwise(F.col("c_mktsegment")).alias("fingerprint"), F.lit(1).alias("parser_version"))
    return relations.needs_build(wanted, built)


def cluster_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as clusters with the number of their customers, suppliers and open accounts."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cluster_id"))
    c, s = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "cluster_id"), read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "cluster_id")
    return relations.cluster_counts(n, c, s, c.filter("c_acctbal < 0"))


def snapshot_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every file of each snapshot (a source) in order, with their place among the chunks of symbols."""
    own = W.partitionBy("source", "rel_path").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    return retrieval.index(spark, sf_dir).chunks.select("rel_path", "chunk_index", F.count_if(F.col("chunk_type").isin("function", "class")).over(own).alias("place"), F.char_length("content").alias("n_chars"))


def soft_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by value through the soft relevance-diversity rule; values of 3 and less count as no score."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), "event_id", F.greatest(F.lit(0.0), F.col("value") - 3).alias("score"))
    return ranking.diversity(rows, [F.desc("score"), F.col("event_id")]).groupBy("query_id").agg(F.count("*").alias("kept"), F.max("event_id").alias("last"))


def penalised_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by value, where a penalty of 0.65 removes those too much like one kept before; an event's tokens are its type and digits of its numbers."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    tokens = F.array("event_type", F.concat(F.lit("a"), i % 3), F.concat(F.lit("b"), F.floor(i / 3) % 4), F.concat(F.lit("c"), F.floor(i / 12) % 3))
    rows = e.select(F.col("user_id").alias("query_id"), "event_id", F.col("value").alias("score"), tokens.alias("tokens")).withColumn("_k", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "event_id"))).filter("_k <= 30").drop("_k")
    kept = ranking.diversity(rows, [F.desc("score"), F.col("event_id")], 0.65, "tokens")
    return kept.select("query_id", "event_id")


def maintained_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term statistics after three batches of changes to documents, one of which comes twice: some are new, some go, some are changed."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("content"), (F.col("doc_id") % 10).alias("k"))
    other = d.filter("k = 2").withColumn("content", F.concat_ws(" ", F.lit("changed"), "lang", F.substring("content", 1, 200)))
    stats = bm25.full_statistics(d.filter("k < 7"))
    none = d.limit(0)
    for batch, gone, come in ((1, none, d.filter("k = 7")), (2, d.filter("k = 2"), other), (2, d.filter("k = 2"), other), (3, d.filter("k = 1").union(other.filter("lang = 'en'")), d.filter("k = 8"))):
        stats = bm25.changed_statistics(stats, gone, come, batch)
    return bm25.weights(stats).select("term", "df", F.round("idf", 6).alias("idf"))


def previous_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order other than the newest of all, as the snapshot before."""
    s = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    newest = s.orderBy(F.desc("created_at"), F.desc("id")).first()["id"]
    return search.previous_snapshot(s, newest)


def exported_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols as rows of an export: distinct, without test paths, in order of path, line and name, every field quoted."""
    s = _symbols(spark, sf_dir).withColumn("rel_path", F.when(F.col("line") % 5 == 0, F.concat(F.lit("tests/"), "rel_path")).otherwise(F.col("rel_path")))
    return search.export_rows(s, "snap", ["rel_path", "line", "name", "kind", "parent_name"])


def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a scan by category: those that are not left out, of them tests and binary ones."""
    facts = path_facts(spark, sf_dir).select("doc_id", "category", "ignored", "is_test")
    both = facts.join(file_contents(spark, sf_dir).select("doc_id", "binary"), "doc_id").filter("not ignored")
    return both.groupBy("category").agg(F.count("*").alias("files"), F.count_if("is_test").alias("tests"), F.count_if("binary").alias("binary_files"), F.count_if(~F.col("is_test") & ~F.col("binary")).alias("kept"))


def report_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents as a folder of reports: whether it is a valid set, and its fingerprint."""
    names = ["GEN.BD-A.report.md", "GEN.DD.COBOL-P.report.md", "GEN.DD.JCL-J.report.md", "notes.md", "x.txt"]
    name = F.concat(F.when(F.col("doc_id") < 20, _at(names, F.col("doc_id"))).otherwise(_at(names[1:], F.col("doc_id"))), F.when(F.col("doc_id") < 20, "").otherwise(F.concat(F.col("doc_id"), F.lit(".md"))))
    return relations.report_set(read(spark, sf_dir, "documents").select(F.col("source").alias("folder"), name.alias("name"), F.col("text").alias("content")), 64)


def evidence_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of every supplier as an evidence payload: how many are kept, and its hash."""
    return relations.payload_hash(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey")


def stored_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of lines to store, with the number of their evidence rows."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("predicate"), F.col("l_suppkey").cast("string").alias("subject"), (F.col("l_partkey") % 30).cast("string").alias("object")).agg(F.sort_array(F.collect_set("l_linenumber")).alias("sites"))
    compared = rows.select("predicate", "subject", "object", F.when(F.col("predicate") == "A", "bd").alias("side"), F.lit("MATCH").alias("verdict"), F.lit("NOT_APPLICABLE").alias("multiplicity"), "sites")
    stored, sites = relations.evidence(compared)
    return stored.join(sites.groupBy("comparison_id").agg(F.count("*").alias("n"), F.max("line").alias("last")), "comparison_id").select("comparison_id", "predicate", "side", "n", "last")


def absorbed_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in small groups, absorbed by the group they trade with most, groups named by their smallest member."""
    edges, _ = graphs._nation_labels(spark, sf_dir)
    both = edges.union(edges.select("dst", "src")).toDF("a", "b").filter("a <> b").groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))
    labels = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("node"), F.concat(F.lit("c"), F.col("n_nationkey") % 13).alias("community"))
    return communities.canonical(communities.absorb(checkpoint(both), labels))


def community_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The community of every customer's nation: its size and hubs."""
    edges, labels = graphs._nation_labels(spark, sf_dir)
    nodes = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("node"))
    return communities.lookup(labels, communities.summaries(edges, labels), nodes).select("node", "community", "members", F.array_join("hub_nodes", ",").alias("hub_nodes"))


def community_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the trade between nations, edges inside and between them."""
    return communities.community_counts(*graphs._nation_labels(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        path_facts, file_contents, name_facts, risk_summaries, affected_communities, impact_scores, resolution_classes, code_relations, relation_status, field_checks, document_edges, document_nodes, dataset_aliases, linked_view, not_assessed,
        interface_classes, symbol_index, capped_symbols, fact_occurrences, copybook_resolution, program_resolution, relative_imports, call_owners, annotation_links, legacy_edges, changed_documents, term_decisions, builds_needed, cluster_overview, snapshot_listing, soft_diversity, penalised_diversity, maintained_statistics, previous_snapshots, exported_symbols,
        file_counts, report_sets, evidence_payloads, stored_evidence, absorbed_communities, community_lookup, community_totals,
    )
}

_CYCLE = lambda values, k: "(CASE CAST(" + k + f" AS BIGINT) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"
_LEFT_OUT = r"(^|/)(\.git|node_modules|\.venv|venv|dist|build|target|__pycache__|\.mypy_cache|\.pytest_cache|\.idea|\.vscode)/"
_CONE = f"""{graphs._E}, sb AS (SELECT DISTINCT node AS seed, fe.src AS node, 1 AS hop FROM sd JOIN fe ON sd.node = fe.dst UNION SELECT sb.seed, fe.src, sb.hop + 1 FROM sb JOIN fe ON sb.node = fe.dst WHERE sb.hop < 2), cn AS (SELECT seed, node, min(hop) AS hop FROM sb GROUP BY ALL),
lb AS (SELECT 'p' || p_partkey AS node, p_brand AS community FROM part), dg AS (SELECT node, sum(i) AS i, CAST(3 * sum(i) + sum(o) AS BIGINT) AS score FROM (SELECT src AS node, 0 AS i, 1 AS o FROM fe UNION ALL SELECT dst, 1, 0 FROM fe) GROUP BY node)"""
_FACTS = """
ol AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
kp AS (SELECT DISTINCT 'P' || o_custkey AS called FROM orders WHERE o_orderstatus = 'P'),
sc AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
st AS (SELECT *, 'J' || o_custkey || '.S' || o_orderkey AS own FROM orders WHERE o_custkey IN (SELECT c_custkey FROM sc)),
ca AS (SELECT o_custkey, 'call/P' || o_custkey || '.MAIN.P' || l_partkey AS k, CASE WHEN l_linenumber = 1 THEN 'P' || l_suppkey ELSE 'P' || l_partkey END AS called, l_linenumber AS line FROM ol WHERE o_custkey IN (SELECT c_custkey FROM sc)),
rl AS (
  SELECT 'calls' AS predicate, 'program/P' || o_custkey AS subject, CASE WHEN kp.called IS NULL THEN 'extroutine/' ELSE 'program/' END || ca.called AS object, k AS occurrence, line FROM ca LEFT JOIN kp ON kp.called = ca.called
  UNION ALL SELECT 'runs', 'job/J' || o_custkey, 'step/' || own, 'step/' || own, 2 FROM st
  UNION ALL SELECT 'runs', 'step/' || own, CASE WHEN kp.called IS NULL THEN 'extroutine/' ELSE 'program/' END || 'P' || o_orderkey % 900, 'step/' || own || '->program/P' || o_orderkey % 900, 2 FROM st LEFT JOIN kp ON kp.called = 'P' || o_orderkey % 900
  UNION ALL SELECT 'binds_dd', 'step/J' || o_custkey || '.S' || o_orderkey, 'dd/J' || o_custkey || '.S' || o_orderkey || '.D' || l_linenumber, 'dd/J' || o_custkey || '.S' || o_orderkey || '.D' || l_linenumber, l_linenumber FROM ol WHERE l_returnflag = 'R' AND o_custkey IN (SELECT c_custkey FROM sc)
  UNION ALL SELECT 'copies', 'program/P' || o_custkey, 'copybook/C' || o_orderkey % 50, 'a.cbl::p' || o_custkey || '->b.cpy::c' || o_orderkey % 50, 0 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM sc)
)"""
_LINKED = """
d AS (SELECT 'program/' || s_suppkey AS key, 'program' AS node_type FROM supplier WHERE s_acctbal > 2000 UNION SELECT 'actor/' || n_name, 'actor' FROM nation),
k AS (SELECT 'program/' || l_suppkey AS key, 'program' AS node_type FROM lineitem WHERE l_quantity > 49 UNION SELECT 'dataset/' || l_partkey, 'dataset' FROM lineitem),
e AS (SELECT 'program/' || l_suppkey AS src, 'dataset/' || l_partkey AS dst FROM lineitem),
sp AS (SELECT key FROM d UNION SELECT dst FROM e WHERE src IN (SELECT key FROM d) UNION SELECT src FROM e WHERE dst IN (SELECT key FROM d)),
n AS (SELECT coalesce(d.key, k.key) AS key, coalesce(d.node_type, k.node_type) AS node_type, d.key IS NOT NULL AS in_doc, k.key IS NOT NULL AS in_code FROM d FULL JOIN k ON d.key = k.key),
v AS (SELECT *, CASE WHEN node_type NOT IN ('program', 'job', 'step', 'dd', 'dataset') THEN 'not_assessed' WHEN NOT in_doc THEN 'undocumented' WHEN NOT in_code THEN 'missing' ELSE 'matched' END AS verdict FROM n WHERE key IN (SELECT key FROM sp)),
i AS (SELECT dst AS key, count(*) AS links FROM e WHERE src IN (SELECT key FROM v) AND dst IN (SELECT key FROM v) GROUP BY dst)"""
_SYMBOLS = """
sy AS (SELECT 'f' || p_partkey % 97 || '.py' AS rel_path, replace(p_name, ' ', '_') || '_' || p_size AS name, 'f' || p_partkey % 97 || '.py::' || replace(p_name, ' ', '_') || '_' || p_size || '#' || p_partkey AS fqn,
  CASE p_partkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'interface' END AS kind, CASE WHEN p_partkey % 9 = 0 THEN replace(p_name, ' ', '_') || '_' || (p_size % 7 + 1) END AS base, p_partkey AS line, p_brand AS parent_name FROM part)"""
_TABLE = [("dd_cobol", 0, "calls", 1), ("dd_cobol", 1, "copies", 2), ("dd_cobol", 2, "field_pic", 1), ("dd_jcl", 3, "runs", 1), ("dd_jcl", 4, "binds_dd", 2), ("bd", 5, "accesses", 1), ("bd", 6, "references", 1), ("bd", 7, "depends", 1)]
_CHUNKS = retrieval._CHUNKS
_R = ["GEN.BD-A.report.md", "GEN.DD.COBOL-P.report.md", "GEN.DD.JCL-J.report.md", "notes.md", "x.txt"]
_REPORTS = f"r AS (SELECT source, text, CASE WHEN doc_id < 20 THEN {_CYCLE(_R, 'doc_id')} ELSE {_CYCLE(_R[1:], 'doc_id')} || doc_id || '.md' END AS name FROM documents)"
_WORDS = "split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b"
ORACLES = {
    "path_facts": f"""WITH p AS (SELECT doc_id, lang, {_CYCLE(DIRS, 'doc_id')} || {_CYCLE(NAMES, 'doc_id // 12')} AS rel_path, {_CYCLE(NAMES, 'doc_id // 12')} AS name FROM documents), q AS (SELECT *, lower(rel_path) AS low, lower(regexp_extract(name, '[^.](\\.[^.]+)$', 1)) AS ext FROM p)
SELECT doc_id, rel_path, CASE WHEN name = 'CMakeLists.txt' THEN 'cmake' WHEN ext = '.py' THEN 'python' WHEN ext = '.ts' THEN 'typescript' WHEN ext = '.js' THEN 'javascript' WHEN ext = '.md' THEN 'markdown' WHEN ext = '.rs' THEN 'rust' WHEN ext = '.yaml' THEN 'yaml' WHEN lang = 'en' THEN 'python' END AS language,
CASE WHEN contains(low, 'key') OR contains(low, '.env') THEN 'secret-risk' WHEN ext = '.png' THEN 'asset' WHEN ends_with(low, '.min.js') OR ends_with(low, '.lock') THEN 'generated' WHEN contains(low, 'migration') THEN 'migration' WHEN contains(low, 'test') THEN 'test' WHEN starts_with(low, 'docs/') OR ext = '.md' THEN 'docs'
WHEN lower(name) = 'dockerfile' OR starts_with(low, '.github/') OR starts_with(low, 'infra/') THEN 'infra' WHEN ext = '.yaml' THEN 'config' WHEN ext IN ('.py', '.ts', '.js', '.rs') THEN 'source' ELSE 'other' END AS category,
regexp_matches(rel_path, '{_LEFT_OUT}') AS ignored, contains(low, 'test') AS is_test, lower(name) IN ('main.py', 'index.ts') OR contains(low, '/bin/') OR contains(low, '/cmd/') OR (contains(low, '/routes/') AND (contains(name, 'index.') OR contains(name, 'router'))) AS entrypoint, name = '__init__.py' AS is_init,
CASE name WHEN 'GEN.BD-X.md' THEN 'bd' WHEN 'GEN.DD.COBOL-P.md' THEN 'dd_cobol' WHEN 'GEN.DD.JCL-J.md' THEN 'dd_jcl' END AS kind FROM q""",
    "name_facts": f"""WITH w AS (SELECT *, {_WORDS} FROM part), t AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN list_filter([lower(a || b), lower(a), lower(b)], lambda x: length(x) > 1) ELSE list_filter([lower(a || '_' || b), lower(a), lower(b)], lambda x: length(x) > 1) END AS terms, {_CYCLE(['program', 'step', 'copybook', 'field', 'dataset', 'br'], 'p_partkey')} AS kind,
{_CYCLE(['SORTOUT', 'IN1', 'STEPLIB', 'DATA'], 'p_partkey')} AS dd, CASE p_type WHEN 'ECONOMY' THEN 'NEW' WHEN 'SMALL' THEN 'SHR' ELSE '' END AS disp FROM w)
SELECT p_partkey, array_to_string(terms, ' ') AS terms, p_size || CASE WHEN p_partkey % 3 = 0 THEN '/800' ELSE '' END || '/FB' AS dcb, upper(a) || '.CBL/' || p_size || '/' || CASE WHEN p_partkey % 3 = 1 THEN p_size + 5 ELSE p_size END AS span, p_size || ',12' AS sites,
CASE WHEN disp = 'NEW' OR dd = 'SORTOUT' THEN 'write' WHEN dd IN ('IN1', 'STEPLIB') OR disp = 'SHR' THEN 'read' END AS mode, CASE WHEN disp = 'NEW' OR dd <> 'DATA' THEN true WHEN disp = 'SHR' THEN false END AS definitive,
kind || '/' || CASE kind WHEN 'field' THEN p_name || '.cpy' WHEN 'step' THEN upper(a) WHEN 'copybook' THEN upper(p_name) WHEN 'br' THEN a || '-' || b || 'cpy' ELSE upper(p_name) || '.CPY' END AS node, a || '%20' || b || '%26' || replace(p_brand, '#', '%23') AS quoted, upper(a) AS artifact, p_name AS normal,
CAST(CASE WHEN p_size < 25 THEN 1800 WHEN p_size > 40 THEN 1500 ELSE 1300 END AS INTEGER) AS chunk_size FROM t""",
    "risk_summaries": f"WITH RECURSIVE {_CONE}, h AS (SELECT seed, hop, count(*) AS n FROM cn GROUP BY ALL) SELECT cn.seed, count(*) AS total, count(*) FILTER (hop <= 1) AS high_risk, count(DISTINCT community) AS communities, (SELECT string_agg(hop || '=' || n, ',' ORDER BY hop) FROM h WHERE h.seed = cn.seed) AS by_hop FROM cn JOIN lb USING (node) GROUP BY cn.seed",
    "affected_communities": f"WITH RECURSIVE {_CONE}, x AS (SELECT cn.seed, lb.community, cn.node, coalesce(dg.score, 0) AS score, row_number() OVER (PARTITION BY cn.seed, lb.community ORDER BY coalesce(dg.score, 0) DESC, cn.node) AS r FROM cn JOIN lb USING (node) LEFT JOIN dg USING (node)) SELECT seed, community, count(*) AS n, string_agg(node, ',' ORDER BY r) FILTER (r <= 5) AS hubs FROM x GROUP BY ALL",
    "impact_scores": f"""WITH RECURSIVE {_CONE}, h AS (SELECT node, min(hop) AS hop FROM cn GROUP BY node), c AS (SELECT node, row_number() OVER (ORDER BY score DESC, i DESC, node) - 1 AS rank FROM dg QUALIFY row_number() OVER (ORDER BY score DESC, i DESC, node) <= 30)
SELECT h.node, CAST(hop AS INTEGER) AS hop, round(CASE hop WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.2 END + 0.3 * dg.score / 10.0 + CASE WHEN hop = 1 THEN 2.5 ELSE 0 END + CASE WHEN lb.community IN (SELECT community FROM lb WHERE node IN (SELECT node FROM sd)) THEN 1.0 ELSE 0 END + coalesce(2.0 * pow(0.94, c.rank), 0), 6) AS impact FROM h LEFT JOIN c USING (node) JOIN lb USING (node) JOIN dg USING (node)""",
    "resolution_classes": f"""WITH p AS (SELECT {_CYCLE(['src/', '__external__/copybook/', '__unresolved__/', '__external__/'], 'p_size')} AS d, {_CYCLE(['DFHAID', 'CEELOC', 'MQOPEN', 'ABEND&X', 'PLAIN'], 'p_partkey')} AS s, {_CYCLE(['import_statement', 'external_utility', 'symbolic_dsn', 'system_copybook', 'copybook_not_found', 'external_runtime'], 'p_partkey // 5')} AS method FROM part)
SELECT CASE WHEN method = 'external_utility' THEN 'predefined_utility' WHEN method = 'symbolic_dsn' THEN 'unresolved_symbolic' WHEN method = 'system_copybook' OR d = '__external__/copybook/' OR s IN ('DFHAID', 'CEELOC') THEN 'system_copybook' WHEN s = 'MQOPEN' OR method = 'external_runtime' THEN 'external_runtime'
WHEN method = 'copybook_not_found' THEN 'not_in_snapshot' WHEN d = '__unresolved__/' THEN CASE WHEN s = 'ABEND&X' THEN 'unresolved_symbolic' ELSE 'not_in_snapshot' END WHEN d = '__external__/' THEN 'external_runtime' ELSE 'resolved' END AS class, method, count(*) AS n FROM p GROUP BY ALL""",
    "code_relations": f"WITH {_FACTS} SELECT predicate, subject, object, count(*) AS n, min(occurrence) AS first, CAST(sum(line) AS BIGINT) AS lines FROM rl GROUP BY predicate, subject, object",
    "relation_status": "SELECT o_orderkey AS cluster_id, CASE WHEN c_custkey IS NULL THEN 'UNBOUND' WHEN o_orderstatus <> CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'O' END THEN 'STALE_INPUT' ELSE 'OK' END AS status FROM orders LEFT JOIN customer ON c_custkey = o_custkey + o_orderkey % 2 * 1000000",
    "field_checks": "WITH l AS (SELECT l_partkey AS part, l_orderkey * 10 + l_linenumber AS id, max('X(' || CAST(l_quantity AS INTEGER) || ')') AS v FROM lineitem GROUP BY ALL), d AS (SELECT part, arg_max(v, id) AS dd_value FROM l GROUP BY part) SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS subject, 'X(' || p_size || ')' AS value, dd_value, sha256('value:' || p_partkey || ':X(' || p_size || '):' || dd_value) AS fingerprint FROM part JOIN d ON part = p_partkey WHERE 'X(' || p_size || ')' <> dd_value",
    "document_edges": "SELECT l_suppkey AS subject, l_partkey % 50 AS object, coalesce(arg_max(CAST(l_quantity AS INTEGER), l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey) FILTER (l_returnflag = 'R' AND l_discount > 0.02), arg_max(CAST(l_quantity AS INTEGER), l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey) FILTER (l_discount > 0.02)) AS value, CASE WHEN bool_or(l_returnflag = 'R') THEN 'authoritative' ELSE arg_min(CASE WHEN l_tax > 0.03 THEN 'corroborating' ELSE 'unverified' END, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey) END AS confidence, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY 1, 2",
    "document_nodes": """WITH a AS (SELECT user_id, event_type, arg_max(CAST(value AS VARCHAR), event_id) AS v, min(event_id) AS o FROM events GROUP BY ALL)
SELECT user_id % 5 AS cluster_id, 'dataset/' || user_id AS id, 'dataset' AS node_type, (SELECT arg_min(event_type || '-' || event_id, event_id) FROM events e WHERE e.user_id = a.user_id) AS display_name, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS attributes, string_agg(event_type, ',' ORDER BY o) AS documents FROM a GROUP BY user_id""",
    "dataset_aliases": "SELECT 'U' || user_id AS alias, arg_max(event_type || '.' || event_id, event_id) AS dsn FROM events GROUP BY user_id",
    "linked_view": f"WITH {_LINKED} SELECT v.key, node_type, in_doc, in_code, verdict, coalesce(links, 0) AS links FROM v LEFT JOIN i ON i.key = v.key",
    "not_assessed": f"WITH {_LINKED} SELECT node_type, verdict, count(*) AS n FROM v GROUP BY ALL",
    "interface_classes": f"WITH {_SYMBOLS} SELECT base AS interface, fqn FROM sy WHERE kind = 'class' AND base IN (SELECT name FROM sy WHERE kind = 'interface')",
    "symbol_index": f"WITH {_SYMBOLS}, k AS (SELECT rel_path || '::' || parent_name || '.' || name AS fqn, unnest([lower(name), lower(parent_name || '.' || name), lower(rel_path || '::' || parent_name || '.' || name)]) AS key FROM sy) SELECT key, count(*) AS n, min(fqn) AS first FROM k GROUP BY key",
    "capped_symbols": "WITH d AS (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag, l_linenumber FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS i FROM d) SELECT l_suppkey AS rel_path, count(*) AS n, max(l_linenumber) AS last FROM r WHERE i <= 2000 GROUP BY 1",
    "fact_occurrences": "WITH r AS (SELECT l_orderkey AS rel_path, l_partkey % 3 AS semantic_key, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_linenumber, l_partkey * 100000 + l_suppkey * 50 + l_quantity) - 1 AS a, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey * 100000 + l_suppkey * 50 + l_quantity) AS b FROM lineitem) SELECT rel_path, semantic_key, CAST(max(a) AS INTEGER) AS last_ix, CAST(max(b) AS INTEGER) AS last_ordinal FROM r GROUP BY ALL",
    "copybook_resolution": f"WITH f AS (SELECT DISTINCT l_suppkey || '.cbl' AS src_path, {_CYCLE(['A', 'DFH', 'B', 'CEE'], 'l_partkey')} || l_partkey % 40 AS name FROM lineitem), i AS (SELECT {_CYCLE(['A', 'DFH', 'B', 'CEE'], 'p_partkey')} || (p_partkey % 60 + 10) AS name, 'cpy/' || p_size || '.cpy' AS path FROM part WHERE p_size < 20), g AS (SELECT name, count(DISTINCT path) AS n, min(path) AS path FROM i GROUP BY name) SELECT src_path, f.name, CASE WHEN n = 1 THEN path ELSE '__external__/copybook/' || f.name END AS dst_path, CASE WHEN n = 1 THEN 'cobol_copy_statement' WHEN n > 1 THEN 'ambiguous_copybook' WHEN regexp_matches(f.name, '^(DFH|CEE)') THEN 'system_copybook' ELSE 'copybook_not_found' END AS resolution_method, CAST(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS confidence_score FROM f LEFT JOIN g ON g.name = f.name",
    "program_resolution": "WITH f AS (SELECT DISTINCT 'j' || o_custkey || '.jcl' AS src_path, 'PG' || o_orderkey % 500 AS name FROM orders), g AS (SELECT 'PG' || c_custkey % 400 AS name, count(DISTINCT c_custkey // 800) AS n, min('n' || c_custkey // 800 || '.cbl') AS path FROM customer GROUP BY 1) SELECT src_path, f.name, CASE WHEN n = 1 THEN path ELSE '__external__/program/' || f.name END AS dst_path, CASE WHEN n = 1 THEN 'jcl_exec_statement' WHEN n > 1 THEN 'ambiguous_program_id' ELSE 'program_not_in_snapshot' END AS resolution_method, CAST(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS confidence_score, coalesce(n, 0) <> 1 AS is_external FROM f LEFT JOIN g ON g.name = f.name",
    "relative_imports": f"WITH t AS (SELECT p_partkey AS id, 'm/' || replace(p_name, ' ', '_') || p_size % 12 AS base FROM part), f AS (SELECT DISTINCT 'm/' || replace(p_name, ' ', '_') || p_size % 20 || {_CYCLE(['', '.py', '.tsx', '/index.js', '.md'], 'p_partkey')} AS path FROM part), e AS (SELECT unnest(['', '.py', '.ts', '.tsx', '.js', '.jsx', '/index.py', '/index.ts', '/index.tsx', '/index.js']) AS ending, unnest(range(0, 10)) AS o), h AS (SELECT id, arg_min(path, o) AS path FROM t, e JOIN f ON f.path = base || ending GROUP BY id) SELECT t.id, base, path FROM t LEFT JOIN h ON h.id = t.id",
    "call_owners": "WITH RECURSIVE a AS (SELECT c_custkey AS class, c_custkey AS anc, 0 AS depth FROM customer UNION SELECT class, anc // 2, depth + 1 FROM a WHERE anc > 0 AND depth < 20), b AS (SELECT class, anc, min(depth) AS depth FROM a GROUP BY ALL), x AS (SELECT o_orderkey AS call_id, arg_min(anc, (depth, anc)) AS owner FROM orders JOIN b ON b.class = o_custkey JOIN customer ON c_custkey = anc AND c_nationkey % 7 = o_orderkey % 9 GROUP BY 1) SELECT o_orderkey AS call_id, owner FROM orders LEFT JOIN x ON call_id = o_orderkey",
    "annotation_links": "WITH e AS (SELECT DISTINCT p_partkey % 20 AS entity_id, upper(split_part(p_name, ' ', CAST(p_partkey % 2 + 1 AS INTEGER))) AS word FROM part), w AS (SELECT p_partkey AS note_id, unnest([upper(split_part(p_name, ' ', 1)), upper(split_part(p_name, ' ', 2)), upper(p_type), 'BRAND', split_part(p_brand, '#', 2)]) AS word FROM part) SELECT DISTINCT note_id, entity_id FROM w JOIN e USING (word) WHERE note_id <> entity_id",
    "legacy_edges": "SELECT l_suppkey AS src_symbol, l_partkey AS dst_symbol, l_returnflag AS edge_type, round(arg_min(l_discount, (l_orderkey, l_linenumber, l_discount, l_quantity)), 6) AS confidence_score, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines FROM lineitem WHERE l_tax > 0 AND l_linestatus <> 'O' GROUP BY 1, 2, 3",
    "changed_documents": "SELECT doc_id AS rel_path, sha256(coalesce(text, '')) AS sha FROM documents WHERE lang NOT IN ('en', 'de') OR source = 'src1'",
    "term_decisions": "WITH c AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 50 = 0) AS k FROM documents) SELECT n AS chunks, 0 AS changed, 'reuse' AS decision, 'same' AS case FROM c UNION ALL SELECT n, 0, 'full', 'fiftieth' FROM c UNION ALL SELECT n, k, 'delta', 'changed' FROM c UNION ALL SELECT n, n, 'full', 'none' FROM c",
    "builds_needed": "SELECT c_custkey AS id, c_mktsegment = 'BUILDING' OR c_acctbal < 0 OR c_nationkey % 2 <> 1 AS build FROM customer",
    "cluster_overview": "SELECT n_nationkey AS cluster_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS documents, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS nodes, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS mismatches FROM nation",
    "soft_diversity": "WITH s AS (SELECT user_id, event_id, greatest(0.0, value - 3) AS score FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM s) SELECT user_id AS query_id, count(*) AS kept, max(event_id) AS last FROM r WHERE n <= 3 OR i <= 5 OR score > 0 GROUP BY 1",
    "penalised_diversity": """WITH RECURSIVE e AS (
  SELECT user_id AS q, event_id, value AS s, [event_type, 'a' || (event_id % 3), 'b' || (event_id // 3 % 4), 'c' || (event_id // 12 % 3)] AS t, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events
), f AS (SELECT *, count(*) OVER (PARTITION BY q) AS n FROM e WHERE r <= 30),
w AS (
  SELECT q, CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[][]) AS sets, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT q FROM f)
  UNION ALL
  SELECT q, r, CASE WHEN k THEN list_append(sets, t) ELSE sets END, CASE WHEN k THEN event_id END FROM (
    SELECT f.*, w.sets, f.n <= 3 OR f.r <= 5 OR (1 - 0.65) * f.s - 0.65 * coalesce(list_max([CAST(len(list_intersect(f.t, y)) AS DOUBLE) / len(list_distinct(list_concat(f.t, y))) FOR y IN w.sets]), 0) * f.s > 0 AS k FROM w JOIN f ON f.q = w.q AND f.r = w.r + 1) AS g
) SELECT q AS query_id, event_id FROM w WHERE event_id IS NOT NULL""",
    "maintained_statistics": """WITH d AS (
  SELECT text AS t FROM documents WHERE doc_id % 10 IN (0, 3, 4, 5, 6, 7, 8) UNION ALL SELECT concat_ws(' ', 'changed', lang, substr(text, 1, 200)) FROM documents WHERE doc_id % 10 = 2 AND lang <> 'en'
), w AS (SELECT row_number() OVER () AS i, regexp_extract_all(lower(coalesce(t, '')), '[A-Za-z0-9_]+') AS ws FROM d), p AS (SELECT DISTINCT i, unnest(ws) AS term FROM w), g AS (SELECT count(*) AS n FROM w)
SELECT term, count(*) AS df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM p, g GROUP BY term HAVING count(*) >= 2""",
    "previous_snapshots": "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1 OFFSET 1",
    "snapshot_listing": f"WITH {_CHUNKS} SELECT rel_path, CAST(chunk_index AS INTEGER) AS chunk_index, count(*) FILTER (regexp_matches(content, '[0-9]{{3}}')) OVER (PARTITION BY source, rel_path ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS place, CAST(length(content) AS INTEGER) AS n_chars FROM c",
    "report_sets": f"WITH {_REPORTS}, m AS (SELECT *, CASE WHEN contains(name, 'BD-') THEN 0 WHEN contains(name, 'COBOL') THEN 1 WHEN contains(name, 'JCL') THEN 2 ELSE 3 END AS rank, name || ':' || sha256(coalesce(text, '')) AS part FROM r WHERE name LIKE '%.md'), k AS (SELECT source, ceil(count(*) / 64.0) AS k FROM m GROUP BY source), h AS (SELECT m.source, CAST('0x' || substr(md5(name), 1, 8) AS BIGINT) % CAST(k AS BIGINT) AS num, sha256(string_agg(part, chr(10) ORDER BY rank, name, part)) AS d FROM m JOIN k ON k.source = m.source GROUP BY ALL), g AS (SELECT source, sha256(string_agg(d, chr(10) ORDER BY num)) AS fingerprint FROM h GROUP BY source) SELECT source AS folder, count(*) FILTER (rank = 0) AS bd, count(*) FILTER (rank IN (1, 2)) AS dd, count(*) FILTER (rank = 0) = 1 AND count(*) FILTER (rank IN (1, 2)) > 0 AS valid, any_value(g.fingerprint) AS fingerprint FROM m JOIN g USING (source) GROUP BY source",
    "evidence_payloads": "WITH d AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS i FROM d) SELECT l_suppkey, CAST(count(*) FILTER (i <= 50) AS INTEGER) AS kept, count(*) FILTER (i > 50) AS truncated, sha256('{\"items\":[' || string_agg(l_orderkey, ',' ORDER BY l_orderkey) FILTER (i <= 50) || '],\"truncated\":' || count(*) FILTER (i > 50) || '}') AS hash FROM r GROUP BY l_suppkey",
    "stored_evidence": "SELECT sha256(concat_ws('|', l_returnflag, l_suppkey, l_partkey % 30, CASE WHEN l_returnflag = 'A' THEN 'bd' ELSE '' END)) AS comparison_id, l_returnflag AS predicate, CASE WHEN l_returnflag = 'A' THEN 'bd' END AS side, count(DISTINCT l_linenumber) AS n, max(l_linenumber) AS last FROM lineitem GROUP BY l_returnflag, l_suppkey, l_partkey % 30",
    "absorbed_communities": f"""WITH RECURSIVE {graphs._TRADE}, l AS (SELECT CAST(n_nationkey AS VARCHAR) AS node, 'c' || n_nationkey % 13 AS c FROM nation), z AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM l GROUP BY c HAVING count(*) < 3),
b AS (SELECT a.c AS ca, x.c AS cb, count(*) AS w FROM (SELECT src, dst FROM tr UNION ALL SELECT dst, src FROM tr) t JOIN l a ON a.node = src JOIN l x ON x.node = dst WHERE a.c <> x.c GROUP BY ALL),
r AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) AS m
  UNION ALL
  SELECT z.k, map_concat(r.m, MAP([z.c], [coalesce((SELECT arg_min(e, (-w, e)) FROM (SELECT e, sum(w) AS w FROM (SELECT coalesce(r.m[b.cb], b.cb) AS e, b.w FROM b WHERE b.ca = z.c) WHERE e <> z.c GROUP BY e)), z.c)])) FROM r JOIN z ON z.k = r.k + 1
), f AS (SELECT node, coalesce((SELECT m FROM r ORDER BY k DESC LIMIT 1)[c], c) AS c FROM l) SELECT node, min(node) OVER (PARTITION BY c) AS community FROM f""",
    "community_lookup": "WITH s AS (" + graphs.ORACLES["community_summaries"] + ") SELECT CAST(n_nationkey AS VARCHAR) AS node, r_name AS community, members, hub_nodes FROM nation JOIN region ON n_regionkey = r_regionkey JOIN s ON s.community = r_name WHERE n_nationkey IN (SELECT c_nationkey FROM customer)",
    "community_totals": f"WITH {graphs._TRADE} SELECT (SELECT count(DISTINCT community) FROM lb) AS communities, (SELECT count(*) FROM (SELECT community FROM lb GROUP BY community HAVING count(*) = 1)) AS singletons, count(*) FILTER (ca = cb) AS internal, count(*) FILTER (ca <> cb) AS external FROM pl",
    "exported_symbols": f"""WITH {_SYMBOLS} SELECT rel_path, CAST(row_number() OVER (PARTITION BY rel_path ORDER BY line) AS INTEGER) AS place, '"snap","' || rel_path || '","' || line || '","' || name || '","' || kind || '","' || parent_name || '"' AS row FROM sy WHERE line % 5 <> 0 AND NOT contains(rel_path, 'test')""",
}
_BYTES = r"""SELECT doc_id, "binary", size_bytes, CASE WHEN NOT "binary" THEN replace(substr(t, 1, list_max([k FOR k IN range(0, 201) IF strlen(substr(t, 1, k)) <= 200])), chr(65533), '') END AS head
FROM (SELECT doc_id, t, doc_id % 7 = 0 OR (strlen(t) > 2048 AND hex(encode(t)[2049:2049]) BETWEEN '80' AND 'BF') AS "binary", CAST(strlen(t) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS size_bytes FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""
ORACLES["file_contents"] = _BYTES
ORACLES["file_counts"] = f"""WITH pf AS ({ORACLES["path_facts"]}), fc AS ({_BYTES})
SELECT category, count(*) AS files, count(*) FILTER (is_test) AS tests, count(*) FILTER ("binary") AS binary_files, count(*) FILTER (NOT is_test AND NOT "binary") AS kept FROM pf JOIN fc USING (doc_id) WHERE NOT ignored GROUP BY category"""
