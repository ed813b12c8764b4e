"""Relations, signals, exports and sources: the cases where a plain reading would go wrong."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import paths as P
from loomspark.operators import communities, documents, ranking, relations, signals
from loomspark.sources import tables


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_graph_files_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1), ("b\"\n", 2)], "node string, degree int")
    edges = spark.createDataFrame([("a", "b\"\n", 0.5)], "src string, dst string, confidence double")
    groups = spark.createDataFrame([("a", ["a", "b"])], "community string, hubs array<string>")
    tables.write_graph(nodes, edges, groups, str(tmp_path / "g"))
    tables.write_graph(nodes, edges, groups, str(tmp_path / "g"))  # again, after communities changed
    assert rows(tables.read_graph(spark, str(tmp_path / "g"), "node", "node string, degree int"), "node", "degree") == rows(nodes, "node", "degree")
    assert rows(tables.read_graph(spark, str(tmp_path / "g"), "edge", "src string, dst string, confidence double"), "src", "dst", "confidence") == rows(edges, "src", "dst", "confidence")
    assert tables.read_graph(spark, str(tmp_path / "g"), "community", "community string, hubs array<string>").first()["hubs"] == ["a", "b"]


def test_report_folders(spark, tmp_path):
    for name, text in {"GEN.BD-A.report.md": b"# A", "GEN.DD.COBOL-P.report.md": b"# P \xff", "other.txt": b"x"}.items():
        (tmp_path / name).write_bytes(text)
    files = tables.read_reports(spark, str(tmp_path))
    assert rows(files, "name", "content") == [("GEN.BD-A.report.md", "# A"), ("GEN.DD.COBOL-P.report.md", "# P ")]
    made = relations.report_set(files).first()
    assert (made.bd, made.dd, made.valid) == (1, 1, True)
    assert relations.report_set(files.filter("name like '%BD%'")).first().valid is False
    with pytest.raises(LookupError):
        relations.require_rows(files.limit(0), "cluster")
    assert relations.require_rows(files, "cluster") is files


def test_lenient_text_leaves_broken_bytes_out(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb" + "é".encode()),), (bytearray("aé".encode()),)], "b binary")
    assert [r[0] for r in df.select(P.lenient_text(F.col("b"), 5), "b").collect()] == ["abé", "aé"]
    assert df.select(P.lenient_text(F.col("b"), 2)).collect()[1][0] == "a"


def test_code_relations_stay_inside_the_scope(spark):
    facts = spark.createDataFrame(
        [
            ("program", "program/A", None, "a.cbl", " a ", None, 1), ("program", "program/B", None, "b.cbl", "B", None, 1), ("call", "call/A.MAIN.B", None, "a.cbl", None, None, 5), ("call", "call/a.MAIN.X", None, "a.cbl", "X", None, 6), ("call", "call/B.MAIN.A", None, "b.cbl", "A", None, 7),
            ("step", "step/J.S1", "job/J", "j.jcl", None, " b ", 2), ("step", "step/J.S2", "job/J", "j.jcl", None, None, 3), ("step", "step/K.S1", "job/K", "k.jcl", "A", None, 2), ("dd", "dd/J.S1.IN", "step/J.S1", "j.jcl", None, None, 4), ("dd", "dd/J.IN", "job/J", "j.jcl", None, None, 4),
        ],
        "fact_type string, semantic_key string, parent_key string, rel_path string, name string, value string, line int",
    )
    copies = spark.createDataFrame([("a.cbl::A", "c.cpy::BOOK"), ("b.cbl::B", "c.cpy::BOOK")], "src string, dst string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = rows(relations.code_relations(facts, copies, names("A"), names("J")), "predicate", "subject", "object")
    assert got == [
        ("binds_dd", "step/J.S1", "dd/J.S1.IN"), ("calls", "program/A", "extroutine/X"), ("calls", "program/A", "program/B"), ("copies", "program/A", "copybook/BOOK"),
        ("runs", "job/J", "step/J.S1"), ("runs", "job/J", "step/J.S2"), ("runs", "step/J.S1", "program/B"),
    ]


def test_floor_falls_back_to_the_best_five(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(9)] + [(2, 1, 10.0), (2, 2, 9.9)], "query_id int, chunk_id int, score double")
    assert rows(signals.above_floor(df), "query_id", "chunk_id") == [(1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (2, 1)]


def test_rerank_target(spark):
    df = spark.createDataFrame([(n,) for n in (0, 10, 100, 120, 134, 1000)], "n long")
    assert [r[0] for r in df.select(signals.rerank_target(F.col("n"))).collect()] == [0, 10, 100, 100, 100, 750]


def test_capped_confidence_and_central_files(spark):
    edges = spark.createDataFrame([("a::x", "b::y", 0.9), ("a::x", "b::y", 0.9), ("a::x", "b::z", 0.9), ("a::w", "b::y", 0.9), ("a::x", "a::q", 0.9), ("c::x", "d::y", 1.0)], "src string, dst string, confidence double")
    stage1 = spark.createDataFrame([(1, "a")], "query_id int, rel_path string")
    central = spark.createDataFrame([("b",)], "rel_path string")
    assert rows(signals.graph_confidence(stage1, edges, central), "rel_path", "rank", "raw_score") == [("a", 2, 0.0), ("b", 1, 3.0)]


def test_term_decision_compares_with_what_was_before(spark):
    chunk = lambda *r: spark.createDataFrame(list(r), "rel_path string, chunk_index int, content_hash string")
    now = chunk(("a", 0, "x"), ("a", 1, "y"))
    decide = lambda before, version=3: relations.term_decision(now, before, version).first().decision
    assert decide(now) == "reuse" and decide(now, 100) == "full" and decide(chunk(("a", 0, "x"))) == "full" and decide(now.limit(0)) == "full"
    wide = chunk(*[("a", i, "x") for i in range(20)])
    assert relations.term_decision(wide, wide.filter("chunk_index > 0"), 3).first().decision == "delta" and relations.term_decision(wide, wide.filter("chunk_index > 1"), 3).first().decision == "full"


def test_louvain_joins_levels(spark):
    """Cliques in a ring: the first level finds cliques or parts of them, the next joins what belongs together."""
    edges = []
    for c in range(8):
        own = [f"{c}-{i}" for i in range(5)]
        edges += [(a, b) for a in own for b in own if a < b] + [(f"{c}-0", f"{(c + 1) % 8}-1")]
    df = spark.createDataFrame(edges, "src string, dst string")
    labels = communities.detect(communities.prepared_edges(df), resolution=1.0)
    assert sum(r.modularity for r in communities.summaries(df, labels).collect()) > 0.6
    assert communities.community_counts(df, labels).first()["singletons"] == 0


def test_edge_merge_keeps_first_and_authoritative(spark):
    claims = spark.createDataFrame([(1, "bd", "p", "q", "calls", "", 3, "unverified"), (2, "dd", "p", "q", "calls", "", 5, "corroborating"), (3, "bd", "p", "r", "calls", "", None, "unverified")], "id int, side string, subject string, object string, edge_type string, edge_key string, value int, confidence string")
    assert rows(documents.project_edges(claims), "object", "value", "confidence", "evidence") == [("q", 5, "authoritative", [1, 2]), ("r", None, "unverified", [3])]


def test_communities_that_swap_names_end(spark, monkeypatch):
    """A level whose nodes only change names joins nothing, so that no further level follows; numbers follow the names without gaps."""
    calls = []

    def swapped(both, rounds, resolution):
        calls.append(1)
        assert len(calls) < 3
        nodes = sorted(r[0] for r in both.select("a").distinct().collect())
        return spark.createDataFrame(list(zip(nodes, reversed(nodes), strict=True)), "node long, community long")

    monkeypatch.setattr(communities, "_moved", swapped)
    edges = spark.createDataFrame([("x", "y", 1.0), ("y", "z", 1.0), ("z", "w", 1.0)], "a string, b string, weight double")
    assert {r.node for r in communities.detect(edges).collect()} == {"w", "x", "y", "z"}
    names = spark.createDataFrame([(f"n{i:03d}",) for i in range(100)], "name string").repartition(7)
    assert [tuple(r) for r in communities._numbered(names).sort("name").collect()] == [(f"n{i:03d}", i) for i in range(100)]


def test_moves_over_blocks_are_those_over_rows(spark, monkeypatch):
    """Edges lie in few rows of arrays, none lost; communities are those of sums over a row for each edge, with weights, loops, ties and lone nodes."""
    rng = random.Random(11)
    once = {}
    for _ in range(400):
        a, b = rng.randrange(90) * 7, rng.randrange(90) * 7
        once[min(a, b), max(a, b)] = float(rng.randint(1, 3))
    once[5000, 5000] = 2.0  # a node of a loop only
    both = spark.createDataFrame([(*e, w) for (a, b), w in once.items() for e in {(a, b), (b, a)}], "a long, b long, weight double").repartition(3)
    monkeypatch.setattr(communities, "BLOCK_EDGES", 100)
    packed = communities._packed(both, 8, 20, "u4", "u1").collect()
    assert len(packed) <= 8 * 3 and {r.block for r in packed} == set(range(8))
    flat = [x for r in packed for x in zip(np.frombuffer(r.a, "u4").tolist(), np.frombuffer(r.b, "u4").tolist(), np.frombuffer(r.weight, "u1").tolist(), np.frombuffer(r.turns, "i4").tolist(), strict=True)]
    assert sorted(x[:3] for x in flat) == sorted(tuple(r) for r in both.filter("a <> b").collect())
    for r in (0, 1, 19):
        now = {x.b for x in both.filter(communities._turn("b", r)).collect()}
        assert all((turns >> r & 1 == 1) == (b in now) for _, b, _, turns in flat)
    tables = spark.catalog.listTables()
    for edges in (both, both.withColumn("weight", F.col("weight") * 0.3 + 300), both.filter("a = b"), both.filter("a <> b and a < 70 and b < 70")):
        for resolution in (0.4, 1.0):
            monkeypatch.setattr(communities, "HUB_EDGES", 4_000_000)
            found = sorted(map(tuple, communities._moved(edges, 6, resolution).collect()))
            monkeypatch.setattr(communities, "HUB_EDGES", 0)
            assert found == sorted(map(tuple, communities._moved(edges, 6, resolution).collect()))
            assert len(found) == edges.select("a").distinct().count()
    assert spark.catalog.listTables() == tables
