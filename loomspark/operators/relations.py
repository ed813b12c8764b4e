"""Canonical code relations, field checks, and the bookkeeping of builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.sources.tables import checkpoint

# Beginnings of copybook names that a system delivers.
SYSTEM_COPYBOOKS = ["CMQ", "DFH", "IGZ", "CEE", "DSN", "ELX"]


def _after(key: Column, kind: str) -> Column:
    """What follows `kind/` in a fact key."""
    return F.substring(key, len(kind) + 2, 1 << 20)


def code_relations(facts: DataFrame, copies: DataFrame, programs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(predicate, subject, object, occurrence, rel_path, line) of what code does, inside a scope of programs and jobs (name).

    facts (fact_type, semantic_key, parent_key, rel_path, name, value, line); copies (src, dst) are symbol edges.  A
    callee that is itself a program of the facts is one, any other is an external routine.
    """
    known = facts.filter("fact_type = 'program' and name is not null").select(F.upper(F.trim("name")).alias("called")).distinct().withColumn("known", F.lit(True))
    inside = lambda df, scope: df.join(scope.select(F.col("name").alias("owner")).distinct(), "owner", "left_semi")

    def routine(df: DataFrame) -> DataFrame:
        """df with `object`, the program or external routine that `called` names."""
        return df.join(known, "called", "left").withColumn("object", F.concat(F.when(F.col("known"), "program/").otherwise("extroutine/"), "called"))

    def rows(df: DataFrame, predicate: str, subject: Column, object_: Column, occurrence: Column) -> DataFrame:
        return df.select(F.lit(predicate).alias("predicate"), subject.alias("subject"), object_.alias("object"), occurrence.alias("occurrence"), "rel_path", "line")

    key = F.col("semantic_key")
    calls = facts.filter("fact_type = 'call'").withColumn("path", F.split(_after(key, "call"), r"\."))
    calls = inside(calls.withColumns({"owner": F.upper(F.element_at("path", 1)), "called": F.coalesce("name", F.upper(F.element_at("path", -1)))}), programs)
    steps = facts.filter("fact_type = 'step'").withColumn("own", _after(key, "step"))
    steps = inside(steps.withColumn("owner", F.upper(F.substring_index("own", ".", 1))), jobs)
    runs = steps.withColumn("called", F.upper(F.trim(F.coalesce("value", "name")))).filter("called <> ''")
    dds = facts.filter("fact_type = 'dd' and parent_key like 'step/%'").withColumn("own", _after(F.col("parent_key"), "step"))
    dds = inside(dds.withColumn("owner", F.upper(F.substring_index("own", ".", 1))), jobs)
    copied = inside(copies.withColumns({"owner": F.upper(F.substring_index("src", "::", -1)), "rel_path": F.lit(""), "line": F.lit(0)}), programs)
    step = F.concat(F.lit("step/"), "own")
    return (
        rows(routine(calls), "calls", F.concat(F.lit("program/"), "owner"), F.col("object"), key)
        .unionByName(rows(steps, "runs", F.concat(F.lit("job/"), "owner"), step, key))
        .unionByName(rows(routine(runs), "runs", step, F.col("object"), F.concat(key, F.lit("->program/"), "called")))
        .unionByName(rows(dds, "binds_dd", step, key, key))
        .unionByName(rows(copied, "copies", F.concat(F.lit("program/"), "owner"), F.concat(F.lit("copybook/"), F.upper(F.substring_index("dst", "::", -1))), F.concat("src", F.lit("->"), "dst")))
    )


def comparison_status(clusters: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(cluster_id, status): UNBOUND without a known snapshot, STALE_INPUT when documents or snapshot changed since the build, else OK."""
    joined = clusters.join(snapshots.select("snapshot_id", F.col("fingerprint").alias("now")), "snapshot_id", "left")
    status = F.when(F.col("now").isNull(), "UNBOUND").when(~F.col("fingerprint").eqNullSafe(F.col("now")), "STALE_INPUT").otherwise("OK")
    return joined.select("cluster_id", status.alias("status"))


def field_differences(bd: DataFrame, dd: DataFrame, by: list[str], what: str) -> DataFrame:
    """Warnings where both designs give a value for the same key and differ; the detailed side's last row counts."""
    last = dd.filter("value is not null").groupBy(*by).agg(F.max_by("value", "id").alias("dd_value"))
    joined = bd.filter("value is not null").join(last, by).filter("value <> dd_value")
    return joined.select(F.lit("value").alias("mismatch_type"), F.lit("warning").alias("severity"), F.lit(what).alias("what"), "id", F.concat_ws("|", *by).alias("subject"), "value", "dd_value")


def once(mismatches: DataFrame, fingerprint: Column, order: str = "id") -> DataFrame:
    """The first mismatch of each fingerprint."""
    own = W.partitionBy("fingerprint").orderBy(order)
    return mismatches.withColumn("fingerprint", fingerprint).withColumn("_r", F.row_number().over(own)).filter("_r = 1").drop("_r")


def implementors(symbols: DataFrame) -> DataFrame:
    """(interface, fqn): the classes that name an interface of the symbols as their base."""
    faces = symbols.filter("kind = 'interface'").select(F.col("name").alias("interface")).distinct()
    return symbols.filter("kind = 'class'").select(F.col("base").alias("interface"), "fqn").join(faces, "interface")


def resolve_copybooks(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Refs (src_path, name) against copybooks (name, path): unique ones resolve; system names and unknown ones are external."""
    found = index.groupBy("name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))
    joined = refs.join(found, "name", "left")
    system = F.rlike(F.upper("name"), F.lit("^(" + "|".join(SYSTEM_COPYBOOKS) + ")"))
    method = F.when(F.col("n") == 1, "cobol_copy_statement").when(F.col("n") > 1, "ambiguous_copybook").when(system, "system_copybook").otherwise("copybook_not_found")
    dst = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.lit("__external__/copybook/"), "name"))
    return joined.select("src_path", "name", dst.alias("dst_path"), method.alias("resolution_method"), F.when(F.col("n") == 1, 1.0).otherwise(0.0).alias("confidence_score"))


def term_decision(now: DataFrame, before: DataFrame, version: int) -> DataFrame:
    """One row (chunks, changed, decision): 'full' without earlier chunks, every 50th version or from a tenth changed; 'reuse' if none changed, else 'delta'.

    Both 'full' and 'delta' give the statistics of all chunks, the latter from what changed (bm25.changed_statistics).

    Chunks (rel_path, chunk_index, content_hash) of this and the earlier snapshot.
    """
    keys = ["rel_path", "chunk_index"]
    joined = now.withColumnRenamed("content_hash", "h").join(before.withColumnRenamed("content_hash", "g"), keys, "full_outer")
    counts = joined.agg(F.count("h").alias("chunks"), F.count("g").alias("earlier"), F.count_if(~F.col("h").eqNullSafe(F.col("g"))).alias("changed"))
    full = (F.col("earlier") == 0) | F.lit(version % 50 == 0) | ((F.col("changed") > 0) & (F.col("changed") >= 0.1 * F.col("chunks")))
    return counts.select("chunks", "changed", F.when(full, "full").when(F.col("changed") > 0, "delta").otherwise("reuse").alias("decision"))


def needs_build(wanted: DataFrame, built: DataFrame) -> DataFrame:
    """(id, build): whether an input (id, fingerprint, parser_version) must be built: unknown, or built from something else."""
    old = built.select("id", F.struct("fingerprint", "parser_version").alias("old"))
    return wanted.join(old, "id", "left").select("id", (~F.struct("fingerprint", "parser_version").eqNullSafe(F.col("old"))).alias("build"))


def unique_symbols(symbols: DataFrame, most: int = 2000) -> DataFrame:
    """Symbols (rel_path, name, kind, line) without repeats, the first `most` of each file by line."""
    own = W.partitionBy("rel_path").orderBy("line", "name", "kind")
    return symbols.dropDuplicates(["rel_path", "name", "kind", "line"]).withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= most).drop("_r")


def occurrences(facts: DataFrame) -> DataFrame:
    """facts (rel_path, semantic_key, kind, parent_key, line, id) with occurrence_ix from 0 for each key of a file, and ordinal from 1 for each kind and parent."""
    by_key = W.partitionBy("rel_path", "semantic_key").orderBy("line", "id")
    by_parent = W.partitionBy("rel_path", "kind", "parent_key").orderBy("line", "id")
    return facts.withColumns({"occurrence_ix": F.row_number().over(by_key) - 1, "ordinal": F.row_number().over(by_parent)})


def cluster_counts(clusters: DataFrame, documents: DataFrame, nodes: DataFrame, mismatches: DataFrame) -> DataFrame:
    """clusters (cluster_id) with the number of their documents, nodes and mismatches, 0 where there are none."""
    out = clusters.select("cluster_id")
    for name, df in (("documents", documents), ("nodes", nodes), ("mismatches", mismatches)):
        out = out.join(df.groupBy("cluster_id").agg(F.count("*").alias(name)), "cluster_id", "left")
    return out.fillna(0)


def node_id(node_type: Column, name: Column) -> Column:
    """`type/NAME`: steps are cut at a blank, ( or @, copybooks lose .CPY, fields, actors and documents keep their case, other types are slugs."""
    from loomspark.functions.text import slugify

    kept = F.trim(name)
    value = (
        F.when(node_type.isin("field", "actor", "doc"), kept)
        .when(node_type == "step", F.upper(F.regexp_extract(kept, r"^([^ (@]*)", 1)))
        .when(node_type == "copybook", F.regexp_replace(F.upper(kept), r"\.CPY$", ""))
        .when(node_type.isin("job", "program", "extroutine", "dataset", "dd"), F.upper(kept))
        .otherwise(slugify(kept))
    )
    return F.concat_ws("/", node_type, value)


def quoted_name(name: Column) -> Column:
    """A dataset or symbolic name as a path segment: every character but letters, digits and _.-~ as its bytes."""
    return F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))


def artifact_name(file: Column) -> Column:
    """The program or job that a report is about: its file name without the marks of its kind."""
    return F.upper(F.regexp_replace(file, r"(?i)^GEN\.DD\.(COBOL|JCL)-|\.report\.md$", ""))


#: Files of a folder whose digests are hashed together.
FILES_A_PART = 1024


def report_set(files: DataFrame, part_files: int = FILES_A_PART) -> DataFrame:
    """For each folder of files (folder, name, content): whether it is a set of reports (one basic and some detailed designs), and its fingerprint.

    The fingerprint is over `name:sha256` of all Markdown files, basic design first, then programs, jobs and others by name, in two steps:
    files are dealt by a digest of their names into parts of about `part_files`, each part is hashed in this order, and then
    the parts' hashes in the order of their numbers.  So no row holds a large folder.
    """
    from loomspark.functions.paths import document_kind

    kind = document_kind(F.col("name"), strict=False)
    rank = F.when(kind == "bd", 0).when(kind == "dd_cobol", 1).when(kind == "dd_jcl", 2).otherwise(3)
    listed = files.filter("lower(name) like '%.md'").select("folder", rank.alias("rank"), "name", F.concat_ws(":", "name", F.sha2(F.coalesce("content", F.lit("")), 256)).alias("line"))
    sizes = listed.groupBy("folder").agg(F.count_if(F.col("rank") == 0).alias("bd"), F.count_if(F.col("rank").isin(1, 2)).alias("dd"), F.ceil(F.count("*") / part_files).alias("parts"))
    sizes = checkpoint(sizes)
    number = F.conv(F.substring(F.md5("name"), 1, 8), 16, 10).cast("long") % F.col("parts")
    joined = lambda rows, what: F.sha2(F.array_join(F.transform(F.sort_array(rows), lambda p: p[what]), "\n"), 256)
    parts = listed.join(sizes.select("folder", "parts"), "folder").groupBy("folder", number.alias("part")).agg(joined(F.collect_list(F.struct("rank", "name", "line")), "line").alias("digest"))
    whole = parts.groupBy("folder").agg(joined(F.collect_list(F.struct("part", "digest")), "digest").alias("fingerprint"))
    return sizes.join(whole, "folder").select("folder", "bd", "dd", ((F.col("bd") == 1) & (F.col("dd") > 0)).alias("valid"), "fingerprint")


def evidence(compared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a comparison (predicate, subject, object, side, verdict, multiplicity, sites) to store, and one evidence row for each site."""
    key = F.sha2(F.concat_ws("|", "predicate", "subject", "object", F.coalesce("side", F.lit(""))), 256)
    rows = compared.withColumn("comparison_id", key)
    return rows.drop("sites"), rows.select("comparison_id", F.posexplode("sites").alias("ix", "line"))


def payload_hash(rows: DataFrame, group: str, value: str, most: int = 50) -> DataFrame:
    """(group, kept, truncated, hash): each group's distinct values as canonical JSON, the first `most` and the number of the others."""
    own = W.partitionBy(group).orderBy(value)
    placed = rows.select(group, value).distinct().withColumn("_r", F.row_number().over(own))
    lists = placed.groupBy(group).agg(F.sort_array(F.collect_list(F.when(F.col("_r") <= most, F.col(value)))).alias("items"), F.count("*").alias("n"))
    body = lists.select(group, F.size("items").alias("kept"), (F.col("n") - F.size("items")).alias("truncated"), "items")
    return body.select(group, "kept", "truncated", F.sha2(F.to_json(F.struct("items", "truncated")), 256).alias("hash"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or an error when it has no row."""
    if df.limit(1).isEmpty():
        raise LookupError(f"not found: {what}")
    return df
