"""Exports as documents, deletion over tables, absorption one after another."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomspark.operators import communities, exports, search
from loomspark.sources import tables


def document(path):
    """A written document, read as a user of the files would: one after another."""
    return json.loads("\n".join(f.read_text() for f in sorted(Path(path).glob("part-*"))))


def test_code_graph_round_trip(spark, tmp_path):
    edges = [("a", "b", "calls", False, 0.5, "m", "resolved"), ("a", "b", "calls", False, 0.9, "n", "resolved"), ("b", "c", "import", False, 1.0, "m", "resolved"), ("c", "__external__/x", "import", True, 0.0, "m", "external_runtime")] + [(f"f{k}", "a", "calls", False, 1.0, "m", "resolved") for k in range(300)]
    e = spark.createDataFrame(edges, "src string, dst string, edge_type string, external boolean, confidence_score double, resolution_method string, resolution_class string")
    names = ["a", "b", 'c "q"\\ü', *(f"f{k}" for k in range(300))]
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    members = spark.createDataFrame([("a", 1), ("b", 2), ('c "q"\\ü', 3), *((f"f{k}", 1) for k in range(300))], "node string, community int")
    cycles = spark.createDataFrame([("a", "b"), ("a", "a"), ("x", "y")], "component string, node string")
    tests = spark.createDataFrame([("t/2",), ("t/1",), ("t/1",)], "path string")
    lines = exports.json_lines(exports.code_graph('s"1', nodes, e, members, cycles, tests))
    exports.write_json(lines, str(tmp_path / "g"), 4)
    assert len(list((tmp_path / "g").glob("part-*"))) > 1
    got = document(tmp_path / "g")
    assert list(got) == ["snapshot_id", "stats", "nodes", "edges", "communities", "community_groups", "community_edges", "cycles", "test_files"]
    assert got["snapshot_id"] == 's"1' and got["nodes"] == sorted([*names, "__external__/x"]) and len(got["edges"]) == 303
    assert [x for x in got["edges"] if x["src"] == "a"] == [{"src": "a", "dst": "b", "edge_type": "calls", "external": False, "confidence_score": 0.9, "resolution_method": "n", "resolution_class": "resolved"}]
    assert got["stats"] == {"node_count": 304, "total_edge_count": 303, "internal_edge_count": 302, "community_count": 3, "singleton_community_count": 2, "cycle_count": 2, "test_file_count": 2}
    assert got["communities"]['c "q"\\ü'] == "3" and got["community_groups"]["2"] == ["b"] and got["community_edges"] == [{"src_community": "1", "dst_community": "2", "edge_count": 1}]
    assert got["cycles"] == [["a", "b"], ["y"]] and got["test_files"] == ["t/1", "t/2"]


def test_document_graph_with_empty_sections(spark, tmp_path):
    some = spark.createDataFrame([(10, "x", None), (9, "y", "z")], "id long, name string, other string")
    summary = spark.createDataFrame([(2, 0)], "node_count int, edge_count int")
    exports.write_json(exports.json_lines(exports.document_graph(summary, some, some.limit(0), some.filter("id = 9"), some.limit(0))), str(tmp_path / "d"))
    assert document(tmp_path / "d") == {"summary": {"node_count": 2, "edge_count": 0}, "nodes": [{"name": "y", "other": "z"}, {"name": "x", "other": None}], "edges": [], "assertions": [{"name": "y", "other": "z"}], "mismatches": []}


def test_external_edges_of_unknown_sources_stay(spark):
    e = spark.createDataFrame([("a", "b", False), ("x", "b", False), ("x", "out", True), ("a", "__init__.py", False)], "src string, dst string, external boolean")
    got = search.export_edges(e, spark.createDataFrame([("a",), ("a",)], "node string"), "__init__")
    assert sorted(map(tuple, got.select("src", "dst", "external").collect())) == [("a", "b", False), ("x", "out", True)]


def test_cascade_over_tables(spark):
    top = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, name string")
    mid = spark.createDataFrame([(10, 1), (11, 2), (12, None), (13, 2)], "m int, top_k int")
    leaf = spark.createDataFrame([(10, 1, "x"), (11, 3, "y"), (12, 3, "z"), (None, 1, "n"), (13, 3, "own")], "mid int, top int, v string")
    alone = spark.createDataFrame([(1,)], "q int")
    given = {"leaf": leaf, "top": top, "mid": mid, "alone": alone}
    links = [("leaf", "mid", "mid", "m"), ("mid", "top_k", "top", "k"), ("leaf", "top", "top", "k")]
    left = tables.cascade(given, links, {"top": F.col("name") == "b", "leaf": F.col("v") == "z"})
    assert {k: sorted(map(str, (tuple(r) for r in df.collect()))) for k, df in left.items()} == {
        "top": ["(1, 'a')", "(3, None)"], "mid": ["(10, 1)", "(12, None)"], "leaf": ["(10, 1, 'x')", "(None, 1, 'n')"], "alone": ["(1,)"],
    }
    with pytest.raises(ValueError):
        tables.cascade(given, [*links, ("top", "k", "leaf", "top")], {})


def one_after_another(edges, labels, least):
    """Small communities by name; each goes where most of its edges lead by then."""
    now = dict(labels)
    first = {}
    for n, c in labels.items():
        first.setdefault(c, []).append(n)
    for c in sorted(first):
        if len(first[c]) >= least:
            continue
        votes = {}
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if x in first[c] and now[y] != c:
                    votes[now[y]] = votes.get(now[y], 0) + w
        if votes:
            to = min(votes, key=lambda k: (-votes[k], k))
            now |= dict.fromkeys(first[c], to)
    return now


@pytest.mark.parametrize("seed", [1, 2])
def test_later_communities_see_where_earlier_ones_went(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k:02}" for k in range(26)]
    labels = {n: f"c{k // (3 if k < 9 else rng.choice([1, 2])):02}" for k, n in enumerate(names)}
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(34)}
    edges = [(a, b, float(rng.randint(1, 2))) for a, b in sorted(pairs)]
    both = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "a string, b string, weight double")
    got = communities.absorb(both, spark.createDataFrame(list(labels.items()), "node string, community string"))
    assert {r.node: r.community for r in got.collect()} == one_after_another(edges, labels, 3)
    chain = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "a string, b string, weight double")
    two = communities.absorb(chain, spark.createDataFrame([("a", "x"), ("b", "y")], "node string, community string"))
    assert {r.community for r in two.collect()} == {"y"}  # x goes to y; y then meets no other
