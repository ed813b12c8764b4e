"""Document-graph operators on small cases."""

from loomspark.operators import documents as D


def test_nodes_merge_in_order(spark):
    rows = spark.createDataFrame([("c", "program/A", 1, "program", "A", {"x": "1", "y": "1"}, "d1"), ("c", "program/A", 2, "program", "Other", {"y": "2"}, "d2"), ("c", "program/A", 3, "program", "A", {}, "d1")], "cluster_id string, id string, ord int, node_type string, display_name string, attributes map<string,string>, doc_id string")
    r = D.merge_nodes(rows).first()
    assert (r.display_name, r.attributes, r.documents) == ("A", {"x": "1", "y": "2"}, ["d1", "d2"])


def test_detailed_design_decides(spark):
    rows = spark.createDataFrame([(1, "A", "B", "calls", "", "bd", 12, "corroborating"), (2, "A", "B", "calls", "", "dd", 13, "authoritative"), (3, "A", "C", "calls", "", "bd", 5, "corroborating"), (4, "A", "B", "calls", "", "bd", 14, "corroborating")], "id int, subject string, object string, edge_type string, edge_key string, side string, value int, confidence string")
    got = {r.object: (r.value, r.confidence, r.evidence) for r in D.project_edges(rows).collect()}
    assert got == {"B": (13, "authoritative", [1, 2, 4]), "C": (5, "corroborating", [3])}
    aliases = spark.createDataFrame([("in", "A.B", 1), ("IN", "C.D", 2)], "alias string, dsn string, ord int")
    assert [(r.alias, r.dsn) for r in D.alias_map(aliases).collect()] == [("IN", "C.D")]


def test_legacy_edges(spark):
    rows = spark.createDataFrame([(1, "a", "b", "calls", 1.0, "m1", 9, False), (2, "a", "b", "calls", 0.5, "m2", 3, False), (3, "a", None, "calls", 1.0, "m", 1, False), (4, "a", "c", "calls", 0.0, "m", 1, True)], "ord int, src_symbol string, dst_symbol string, edge_type string, confidence_score double, resolution_method string, line int, is_external boolean")
    assert [(r.dst_symbol, r.confidence_score, r.resolution_method, r.lines) for r in D.legacy_symbol_edges(rows).collect()] == [("b", 1.0, "m1", [3, 9])]


def test_annotations(spark):
    notes = spark.createDataFrame([("n1", "calls ordprog, not ORD"), ("program/X", "X itself")], "note_id string, text string")
    entities = spark.createDataFrame([("program/ORDPROG", "ORDPROG"), ("program/X", "x")], "entity_id string, name string")
    assert [tuple(r) for r in D.annotation_edges(notes, entities).collect()] == [("n1", "program/ORDPROG")]


def test_methods_resolve_to_the_nearest_ancestor(spark):
    bases = spark.createDataFrame([("C", "B"), ("B", "A"), ("A", "A")], "class string, base string")
    methods = spark.createDataFrame([("A", "f"), ("B", "f"), ("A", "g"), ("C", "h")], "class string, method string")
    calls = spark.createDataFrame([(1, "C", "f"), (2, "C", "g"), (3, "C", "h"), (4, "C", "none"), (5, "A", "g")], "call_id int, class string, method string")
    assert {r.call_id: r.owner for r in D.resolve_method(calls, methods, bases).collect()} == {1: "B", 2: "A", 3: "C", 4: None, 5: "A"}


def test_linked_graph_scope_and_verdicts(spark):
    doc = spark.createDataFrame([("program/A", "program"), ("program/B", "program"), ("field/F", "field")], "key string, node_type string")
    code = spark.createDataFrame([("program/A", "program"), ("step/S", "step"), ("program/FAR", "program")], "key string, node_type string")
    edges = spark.createDataFrame([("step/S", "program/A"), ("program/FAR", "step/S"), ("program/A", "field/F")], "src string, dst string")
    nodes, inner = D.linked_graph(doc, code, edges)
    assert {r.key: r.verdict for r in nodes.collect()} == {"program/A": "matched", "program/B": "missing", "field/F": "not_assessed", "step/S": "undocumented"}
    assert {(r.src, r.dst) for r in inner.collect()} == {("step/S", "program/A"), ("program/A", "field/F")}


def test_risk(spark):
    cone = spark.createDataFrame([("s", "s", 0), ("s", "a", 1), ("s", "b", 1), ("s", "c", 2)], "seed string, node string, hop int")
    labels = spark.createDataFrame([("a", "k1"), ("b", "k1"), ("c", "k2")], "node string, community string")
    degrees = spark.createDataFrame([("a", 3), ("b", 9)], "node string, score long")
    r = D.risk_summary(cone, labels).first()
    assert (r.total, r.high_risk, r.communities, r.by_hop) == (3, 2, 2, {1: 2, 2: 1})
    assert {(r.community, r.n, tuple(r.hubs)) for r in D.affected_communities(cone, labels, degrees, 1).collect()} == {("k1", 2, ("b",)), ("k2", 1, ("c",))}


def test_symbols_and_barrels(spark):
    chunks = spark.createDataFrame([(1, "export * from './a'\nexport { b } from './b'\n"), (2, "import x\ny = 1\nz = 2"), (3, "")], "chunk_id int, content string")
    assert {r.chunk_id: r.is_barrel for r in D.barrels(chunks).collect()} == {1: True, 2: False, 3: False}
    symbols = spark.createDataFrame([("a.py", "Run", "T"), ("a.py", "main", None)], "rel_path string, name string, parent_name string")
    assert {(r.key, r.fqn) for r in D.symbol_keys(symbols).collect()} == {("run", "a.py::T.Run"), ("t.run", "a.py::T.Run"), ("a.py::t.run", "a.py::T.Run"), ("main", "a.py::main"), ("a.py::main", "a.py::main")}
    edges = spark.createDataFrame([("a::x", "b::y", 0.9), ("a::x", "b::y", 0.9), ("a::x", "a::z", 1.0), ("c::x", "b::y", 0.5)], "src string, dst string, confidence double")
    assert [tuple(r) for r in D.confident_neighbours(edges, spark.createDataFrame([("a",)], "rel_path string")).collect()] == [("b", 0.9)]


def test_annotation_pairs_are_dealt_by_their_number(spark):
    """Six notes with two words that name five entities each: 60 pairs before repeats go, of which a task gets ten."""
    notes = spark.createDataFrame([(i, "alpha and beta") for i in range(6)], "note_id long, text string")
    entities = spark.createDataFrame([(k, w) for k in range(5) for w in ("Alpha", "beta")], "entity_id long, name string")
    made = D.annotation_edges(notes, entities, 10)
    assert sorted(map(tuple, made.collect())) == [(i, k) for i in range(6) for k in range(5) if i != k]
    assert made.rdd.getNumPartitions() == 6
