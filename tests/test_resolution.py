"""Call sites, bases and constructions, resolved as a reader of the code would."""

import random

import pytest

from loomspark.operators import resolution as R

DEFS = "fqn string, file string, name string, kind string, class_name string, pos long"
IMPORTS = "file string, local_name string, src_file string, orig_name string, is_star boolean, pos long"
ATTRS = "file string, class_name string, method_name string, attr_name string, assigned_type string, is_construction boolean, pos long"
BASES = "file string, class_name string, base string, pos long"
CALLS = "call_id long, src string, file string, receiver string, method string, line int"


def defs(*rows):
    return [(f"{f}::{c + '.' if c else ''}{n}", f, n, k, c, i) for i, (f, n, k, c) in enumerate(rows)]


@pytest.fixture
def code(spark):
    d = defs(
        ("pkg/a.py", "run", "function", None), ("pkg/a.py", "Base", "class", None), ("pkg/a.py", "go", "method", "Base"), ("pkg/b.py", "Left", "class", None), ("pkg/b.py", "go", "method", "Left"),
        ("pkg/b.py", "Leaf", "class", None), ("pkg/b.py", "own", "method", "Leaf"), ("pkg/b.py", "help", "function", None), ("pkg/c.py", "Shape", "interface", None), ("pkg/c.py", "Disk", "class", None),
        ("pkg/c.py", "area", "method", "Disk"), ("pkg/c.py", "Box", "class", None), ("pkg/c.py", "area", "method", "Box"), ("d.py", "twice", "function", None), ("d.py", "twice", "method", "Box"), ("e.py", "run", "function", None),
    )
    imports = [
        ("d.py", "go_run", "a.py", "run", False, 0), ("d.py", "Sh", "pkg/c.py", "Shape", False, 1), ("d.py", "util", "x/pkg/b.py", None, False, 2), ("d.py", "lost", None, None, False, 3), ("d.py", "later", "nowhere.py", None, False, 4),
        ("d.py", "later", "pkg/b.py", "help", False, 5), ("star.py", "*", "pkg/a.py", None, True, 6), ("d.py", "class_in", "pkg/b.py", "own", False, 7),
    ]
    attributes = [
        ("d.py", "User", "__init__", "one", "Leaf", True, 0), ("d.py", "User", None, "one", "Leaf", True, 1), ("d.py", "User", "set", "many", "Disk", True, 2), ("d.py", "User", "set", "many", "Leaf", False, 3),
        ("d.py", "User", "set", "shape", "Sh", False, 4), ("d.py", "User", "set", "odd", "Nothing", True, 5),
    ]
    bases = [("pkg/b.py", "Left", "Base", 0), ("pkg/b.py", "Leaf", "Left", 1), ("pkg/b.py", "Leaf", "Base", 2), ("pkg/c.py", "Disk", "Shape", 3), ("pkg/c.py", "Box", "Shape", 4), ("pkg/a.py", "Base", "Leaf", 5), ("d.py", "User", "Left", 6)]
    calls = [
        (1, "d.py::main", "d.py", None, "go_run", 1), (2, "d.py::main", "d.py", None, "lost", 2), (3, "d.py::main", "d.py", None, "later", 3), (4, "d.py::main", "d.py", None, "twice", 4), (5, "d.py::main", "d.py", None, "run", 5),
        (6, "star.py::f", "star.py", None, "run", 6), (7, "d.py::User.act", "d.py", "self", "go", 7), (8, "d.py::main", "d.py", "self", "go", 8), (9, "d.py::User.act", "d.py", "self.one", "go", 9), (10, "d.py::User.act", "d.py", "this.many", "area", 10),
        (11, "d.py::User.act", "d.py", "self.shape", "area", 11), (12, "d.py::User.act", "d.py", "self.odd", "go", 12), (13, "d.py::main", "d.py", "util", "help", 13), (14, "d.py::main", "d.py", "other", "help", 14), (15, "e.py::main", "e.py", None, "run", 15),
        (16, "d.py::main", "d.py", None, "go_run", 16), (17, "d.py::main", "d.py", None, "class_in", 17), (18, "d.py::main", "d.py", "util", "own", 18), (19, "pkg/b.py::Leaf.x", "pkg/b.py", "self", "own", 19),
    ]
    frames = {"calls": (calls, CALLS), "definitions": (d, DEFS), "imports": (imports, IMPORTS), "attributes": (attributes, ATTRS), "bases": (bases, BASES)}
    return {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in frames.items()}


def test_calls(code):
    got = {(r.call_id, r.dst, r.confidence, r.resolution_method) for r in R.call_edges(**code).collect()}
    assert got == {
        (1, "pkg/a.py::run", 0.95, "import_path_match"), (3, "pkg/b.py::help", 0.95, "import_path_match"), (7, "pkg/b.py::Left.go", 0.9, "mro_resolved"), (9, "pkg/b.py::Left.go", 0.85, "constructor_type_trace"),
        (10, "pkg/c.py::Disk.area", 0.3, "name_heuristic_ambiguous"), (11, "pkg/c.py::Disk.area", 0.3, "name_heuristic_ambiguous"), (11, "pkg/c.py::Box.area", 0.3, "name_heuristic_ambiguous"), (13, "pkg/b.py::help", 0.95, "import_path_match"),
        (15, "e.py::run", 0.85, "same_file_scope"), (16, "pkg/a.py::run", 0.95, "import_path_match"), (19, "pkg/b.py::Leaf.own", 0.9, "mro_resolved"),
    }


def test_classes_of_an_interface_share_targets(spark):
    """A call on an interface whose classes inherit one method is one edge, not one for each class."""
    n = 500
    d = defs(("a.py", "I", "interface", None), ("a.py", "Top", "class", None), ("a.py", "go", "method", "Top"), ("b.py", "go", "method", "K1"), ("u.py", "act", "method", "User"))
    frames = {
        "calls": ([(k, "u.py::User.act", "u.py", "self.x", "go", k) for k in range(20)], CALLS), "definitions": (d, DEFS), "imports": ([], IMPORTS), "attributes": ([("u.py", "User", None, "x", "I", False, 0)], ATTRS),
        "bases": ([(f"k{k}.py", f"K{k}", base, 2 * k + j) for k in range(n) for j, base in enumerate(("I", "Top"))], BASES),
    }
    frames = {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in frames.items()}
    rows = [tuple(r) for r in R.call_edges(**frames).select("call_id", "dst", "confidence").collect()]
    assert sorted(rows) == sorted((k, dst, 0.15) for k in range(20) for dst in ("a.py::Top.go", "b.py::K1.go"))
    assert R.symbol_edges(**frames).filter("edge_type = 'calls'").select("dst", "line").distinct().count() == 2


def test_all_edges_once(code):
    rows = R.symbol_edges(**code).collect()
    assert len({(r.src, r.dst, r.edge_type, r.confidence >= 0.7) for r in rows}) == len(rows)
    other = {(r.src, r.dst, r.edge_type, r.confidence) for r in rows if r.edge_type != "calls"}
    assert other == {
        ("pkg/b.py::Left", "pkg/a.py::Base", "extends", 1.0), ("pkg/b.py::Leaf", "pkg/b.py::Left", "extends", 1.0), ("pkg/b.py::Leaf", "pkg/a.py::Base", "extends", 1.0), ("pkg/c.py::Disk", "pkg/c.py::Shape", "extends", 1.0),
        ("pkg/c.py::Box", "pkg/c.py::Shape", "extends", 1.0), ("pkg/a.py::Base", "pkg/b.py::Leaf", "extends", 1.0), ("d.py::User", "pkg/b.py::Left", "extends", 1.0), ("d.py::User.__init__", "pkg/b.py::Leaf", "instantiates", 1.0),
        ("d.py::User.set", "pkg/c.py::Disk", "instantiates", 1.0),
    }
    assert [r.line for r in rows if r.src == "d.py::main" and r.dst == "pkg/a.py::run"] == [1]


def first_along(start, method, bases, has):
    """Depth first from base to base, no class twice on a way."""
    def look(c, way):
        if (c, method) in has:
            return has[c, method]
        for b in bases.get(c, []):
            if b not in way and len(way) <= R.MOST_BASES and (found := look(b, (*way, b))):
                return found
        return None

    return look(start, (start,))


def test_inheritance_against_recursion(spark):
    """Random bases with diamonds and cycles, long chains, several definitions of one class."""
    rng = random.Random(6)
    bases, rows = {}, []
    for c in range(40):
        for b in dict.fromkeys(rng.sample(range(40), rng.choice([0, 1, 1, 2]))):
            bases.setdefault(f"c{c}", []).append(f"c{b}")
    for k in range(30):
        bases[f"d{k}"] = [f"d{k + 1}"]
    pos = 0
    for c, own in bases.items():
        for b in own:
            rows.append((f"f{rng.randrange(9)}.py", c, b, pos))
            rows.append((f"f{rng.randrange(9)}.py", c, b, 1000 + pos))
            pos += 1
    d = [(f"x{k}::c{k % 40}.m{k % 5}", "x", f"m{k % 5}", "method", f"c{(k * 7) % 40}", k) for k in range(60)] + [("x::d21.m0", "x", "m0", "method", "d21", 100), ("x::d20.m1", "x", "m1", "method", "d20", 101), ("x::m9", "x", "m9", "function", None, 102)]
    has = {}
    for fqn, _, name, _, cls, _ in d:
        has.setdefault((cls, name), fqn)
    wanted = [(c, f"m{k}") for c in [*(f"c{k}" for k in range(40)), "d0", "d1", "absent"] for k in (0, 1, 2, 3, 4, 9)]
    got = R.methods_of(spark.createDataFrame(wanted, "class_name string, method string"), spark.createDataFrame(d, DEFS), spark.createDataFrame(rows, BASES))
    found = {(r.class_name, r.method): r.dst for r in got.collect()}
    assert found == {w: f for w in wanted if (f := first_along(*w, bases, has))}
    assert ("d0", "m1") in found and ("d0", "m0") not in found and ("d1", "m0") in found


def test_empty_tables(code):
    assert R.symbol_edges(**{k: df.limit(0) for k, df in code.items()}).collect() == []
