"""Large JSON documents in a defined order, as lines that no task holds together.

A document is an object of sections: a value, a list, or an object whose keys come from rows.  Each row becomes one line; a
line's place is (section, part, key), so that lines are dealt to files by ranges and the files, one after another, are the document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.sources.tables import checkpoint

OPEN, ITEM, CLOSE = 0, 1, 2


@dataclass(frozen=True)
class Section:
    """A section and its rows: `value` (one row: json), `list` (key, json) in the order of key, or `object` (key, json) by key."""

    name: str
    kind: str
    rows: DataFrame


def json_lines(sections: list[Section]) -> DataFrame:
    """(section, part, key, line): the lines of the document; in order they are one JSON object."""
    out = None
    for k, s in enumerate(sections):
        lead, tail = "{" if k == 0 else ",", "}" if k == len(sections) - 1 else ""
        name = F.to_json(F.struct(F.lit(0).alias(s.name)))  # quoted by the writer of JSON
        head = F.concat(F.lit(lead), F.regexp_extract(name, r"(?s)^\{(.*):0\}$", 1), F.lit(":"))
        rows = s.rows
        if s.kind == "value":
            lines = rows.select(F.lit(ITEM).alias("part"), F.lit("").alias("key"), F.concat(head, "json", F.lit(tail)).alias("line"))
        else:
            opens, closes = ("[", "]") if s.kind == "list" else ("{", "}")
            first = checkpoint(rows.agg(F.min("key").alias("_first")))
            shown = F.col("json") if s.kind == "list" else F.concat(F.regexp_extract(F.to_json(F.array("key")), r"(?s)^\[(.*)\]$", 1), F.lit(":"), "json")
            body = rows.join(F.broadcast(first)).select(F.lit(ITEM).alias("part"), "key", F.concat(F.when(F.col("key") == F.col("_first"), "").otherwise(","), shown).alias("line"))  # one row
            ends = first.select(F.explode(F.array(F.struct(F.lit(OPEN).alias("part"), F.concat(head, F.lit(opens)).alias("line")), F.struct(F.lit(CLOSE).alias("part"), F.lit(closes + tail).alias("line")))).alias("e"))
            lines = body.union(ends.select("e.part", F.lit("").alias("key"), "e.line"))
        placed = lines.select(F.lit(k).alias("section"), "part", "key", "line")
        out = placed if out is None else out.union(placed)
    return out


def write_json(lines: DataFrame, path: str, files: int | None = None) -> None:
    """The lines as text files below a folder (about as many as `files`, else by size), which in the order of their names are the document."""
    order = ["section", "part", "key"]
    dealt = lines.repartitionByRange(files, *order) if files else lines.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def code_graph(snapshot: str, nodes: DataFrame, edges: DataFrame, members: DataFrame, cycles: DataFrame, test_files: DataFrame) -> list[Section]:
    """A code graph's sections: statistics, nodes, edges, communities, their groups and edges, cycles and test files.

    nodes (node), edges (src, dst, edge_type, external, confidence_score, resolution_method, resolution_class), members (node, community), cycles (component, node),
    test_files (path).  Equal edges (src, dst, edge_type, external) are one, the one of the highest confidence; targets outside the code are nodes too.
    """
    outside = edges.filter(F.rlike("dst", F.lit("^__(synthetic|external|unresolved)__/"))).select(F.col("dst").alias("node"))
    every = checkpoint(nodes.select("node").union(outside).distinct())
    key = ["src", "dst", "edge_type", "external"]
    once = checkpoint(edges.groupBy(*key).agg(F.max(F.struct("confidence_score", "resolution_method", "resolution_class")).alias("_e")).select(*key, "_e.*"))
    community = F.col("community").cast("string")
    a, b = members.select(F.col("node").alias("src"), community.alias("src_community")), members.select(F.col("node").alias("dst"), community.alias("dst_community"))
    between = once.filter("not external").join(a, "src").join(b, "dst").filter("src_community <> dst_community").groupBy("src_community", "dst_community").agg(F.count("*").alias("edge_count"))
    paths = test_files.select("path").distinct()
    sizes = members.groupBy("community").agg(F.count("*").alias("n"))
    rings = cycles.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # a cycle is one entry of the document
    counts = {
        "node_count": every, "total_edge_count": once, "internal_edge_count": once.filter("not external"), "community_count": sizes,
        "singleton_community_count": sizes.filter("n = 1"), "cycle_count": rings, "test_file_count": paths,
    }
    stats = every.sparkSession.range(1).select(F.to_json(F.struct(*(F.lit(df.count()).alias(k) for k, df in counts.items()))).alias("json"))
    text = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    rank = F.lpad((F.lit(10**18) - F.col("edge_count")).cast("string"), 19, "0")
    groups = members.groupBy(community.alias("key")).agg(F.to_json(F.sort_array(F.collect_list("node"))).alias("json"))  # a group is one entry of the document
    edge_key = F.concat_ws("\u0001", "src", "dst", "edge_type", F.col("external").cast("string"))
    return [
        Section("snapshot_id", "value", every.sparkSession.range(1).select(text(F.lit(snapshot)).alias("json"))),
        Section("stats", "value", stats),
        Section("nodes", "list", every.select(F.col("node").alias("key"), text(F.col("node")).alias("json"))),
        Section("edges", "list", once.select(edge_key.alias("key"), F.to_json(F.struct(*once.columns)).alias("json"))),
        Section("communities", "object", members.select(F.col("node").alias("key"), text(community).alias("json"))),
        Section("community_groups", "object", groups),
        Section("community_edges", "list", between.select(F.concat_ws("\u0001", rank, "src_community", "dst_community").alias("key"), F.to_json(F.struct(*between.columns)).alias("json"))),
        Section("cycles", "list", rings.select(F.col("component").alias("key"), F.to_json("nodes").alias("json"))),
        Section("test_files", "list", paths.select(F.col("path").alias("key"), text(F.col("path")).alias("json"))),
    ]


def document_graph(summary: DataFrame, nodes: DataFrame, edges: DataFrame, assertions: DataFrame, mismatches: DataFrame) -> list[Section]:
    """A document graph's sections: its summary (one row), nodes, edges, assertions and mismatches, each in the order of its id (long or string)."""
    place = lambda df: F.lpad(F.col("id").cast("string"), 20, "0") if dict(df.dtypes)["id"] in ("int", "bigint") else F.col("id")
    rows = lambda df: df.select(place(df).alias("key"), F.to_json(F.struct(*[c for c in df.columns if c != "id"]), {"ignoreNullFields": "false"}).alias("json"))
    named = {"nodes": nodes, "edges": edges, "assertions": assertions, "mismatches": mismatches}
    return [Section("summary", "value", summary.select(F.to_json(F.struct(*summary.columns)).alias("json"))), *(Section(k, "list", rows(df)) for k, df in named.items())]
