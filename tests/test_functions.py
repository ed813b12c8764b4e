"""Column functions: the cases where a plain reading would go wrong."""

import fnmatch

import pytest
from pyspark.sql import functions as F

from loomspark.functions import paths as P
from loomspark.functions import text as T


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(column).first()[0]


def test_query_terms_are_lowered_before_they_are_split(spark):
    assert one(spark, T.query_terms(F.col("q")), q="getUserById get_user x") == ["getuserbyid", "get_user", "get", "user"]


def test_split_identifier(spark):
    assert one(spark, T.split_identifier(F.col("q")), q="getUserById") == ["getuserbyid", "get", "user", "by", "id"]
    assert one(spark, T.split_identifier(F.col("q")), q="HTTPServer") == ["httpserver", "server"]
    assert one(spark, T.split_identifier(F.col("q")), q="get_user_by_id") == ["get_user_by_id", "get", "user", "by", "id"]
    assert one(spark, T.split_identifier(F.col("q")), q="a") == ["a"]


@pytest.mark.parametrize("n", [0, 1, 1299, 1300, 1301, 2438, 2439, 5000])
def test_flat_chunks_cover_the_text(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    rows = T.flat_chunks(spark.createDataFrame([(1, text)], "id int, text string"), "text", F.lit(1300)).orderBy("chunk_index").collect()
    want, start = [], 0
    while True:
        want.append(text[start : start + 1300])
        if start + 1300 >= n:
            break
        start += 1300 - 162
    assert [r.content for r in rows] == want


def test_categories_take_the_first_that_fits(spark):
    cases = {
        "src/keyboard.py": "secret-risk", "a/logo.png": "asset", "x/app.min.js": "generated", "db/migrations/1.sql": "migration", "src/latest/x.py": "test", "docs/x.py": "docs", "a/README.md": "docs",
        "Dockerfile": "infra", ".github/x.yml": "infra", "a/b.yaml": "config", "a/b.rs": "source", "a/b.unknown": "other", "LICENSE": "other",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", P.category(F.col("p"))).collect()} == cases


def test_languages(spark):
    cases = {("a/CMakeLists.txt", ""): "cmake", ("a.TSX", ""): "typescript", ("run", "#!/usr/bin/env python3"): "python", ("run", "#!/bin/sh"): "bash", ("run", "#!/usr/bin/env deno"): "javascript", ("run", "hello"): None, (".gitignore", ""): None}
    df = P.with_language(spark.createDataFrame(list(cases), "p string, l string"), "p", F.col("l"))
    assert {(r.p, r.l): r.language for r in df.collect()} == cases


def test_document_kinds(spark):
    cases = {"GEN.BD-X.report.md": "bd", "gen.dd.cobol-p.report.md": "dd_cobol", "GEN.DD.JCL-J.report.md": "dd_jcl", "notes.md": None, "DD.COBOL-A.DD.JCL-B.md": None, "BD.DD.JCL-B.md": None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert dict(df.select("p", P.document_kind(F.col("p"), strict=False)).collect()) == cases
    with pytest.raises(Exception, match="design document"):
        df.select(P.document_kind(F.col("p"))).collect()


def test_binary_contents(spark):
    cases = [(b"", False), (b"plain", False), ("été".encode(), False), (b"a\x00b", True), (b"\xff\xfe", True), (b"a" * 2047 + "é".encode(), True), (b"a" * 2048 + b"\x00\xff", False), ("é".encode("latin-1"), True)]
    df = spark.createDataFrame([(bytearray(b), want) for b, want in cases], "b binary, want boolean")
    assert [r for r in df.select("want", P.is_binary(F.col("b")).alias("got")).collect() if r.want != r.got] == []


def test_entrypoints(spark):
    yes = ["main.py", "a/App.py", "x/bin/run", "a/cmd/x.go", "a/manage.py", "a/routes/index.tsx", "a/routes/b/my_router.js"]
    no = ["manage.py", "xmain.py", "routes/index.js", "a/routes/index.d/x.js", "bin/x", "a/__init__.py"]
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert [r[0] for r in df.filter(P.is_entrypoint(F.col("p"))).collect()] == yes
    assert [r[0] for r in df.filter(P.is_init_file(F.col("p"))).collect()] == ["a/__init__.py"]


def test_globs_cross_slashes(spark):
    paths = ["a/b/c.log", "c.log", "node_modules/x/y.js", "src/x.py", "a/[x].txt"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r[0]: r[1] for r in df.select("p", P.ignored(F.col("p"), ["*.log", "a/[[]x].txt"])).collect()}
    assert got == {p: fnmatch.fnmatchcase(p, "*.log") or p.startswith("node_modules/") or p == "a/[x].txt" for p in paths}


def test_small_parsers(spark):
    assert one(spark, T.source_span(F.col("q")), q="ORDPROG.CBL L19-22").asDict() == {"source_artifact": "ORDPROG.CBL", "line_start": 19, "line_end": 22}
    assert one(spark, T.call_sites(F.col("q")), q="L909 (13 call sites), L0012, 7") == [909, 12, 7]
    assert one(spark, T.dcb(F.col("q")), q="LRECL=80,BLKSIZE=800,RECFM=FB").asDict() == {"raw": "LRECL=80,BLKSIZE=800,RECFM=FB", "lrecl": "80", "blksize": "800", "recfm": "FB"}
    assert one(spark, T.slugify(F.col("q")), q="4.2 The  Big - Title!") == "42-the-big-title"
    assert one(spark, T.keyword_count(F.col("q"), "call"), q="call recall call2 CALL call.") == 2
    assert one(spark, T.dd_mode(F.col("n"), F.col("d")), n="SORTOUT", d="SHR").asDict() == {"mode": "write", "definitive": True}
    assert one(spark, T.dd_mode(F.col("n"), F.col("d")), n="INFILE", d="SHR").asDict() == {"mode": "read", "definitive": True}
    assert one(spark, T.dd_mode(F.col("n"), F.col("d")), n="MASTER", d="(SHR)").asDict() == {"mode": "read", "definitive": False}


def test_resolution_classes(spark):
    made = lambda dst, method: one(spark, T.resolution_class(F.col("d"), F.col("m"), ["CMQ", "DFH", "IGZ", "CEE", "DSN", "ELX"], ["ABEND"]), d=dst, m=method)
    assert made("a/B.cbl", "cobol_call_literal") == "resolved"
    assert made("__external__/copybook/X", "copybook_not_found") == "system_copybook"
    assert made("__external__/program/MQOPEN", "program_not_in_snapshot") == "external_runtime"
    assert made("__external__/program/FOO", "program_not_in_snapshot") == "not_in_snapshot"
    assert made("__unresolved__/%26DSN", "x") == "unresolved_symbolic"


def test_impact_score(spark):
    got = one(spark, T.impact_score(F.lit(1), F.lit(2), F.lit(False), F.lit(True), F.lit(True), F.lit(10.0)))
    assert got == pytest.approx(2.0 + 3.0 + 2.5 + 0.4 + 2 * 0.94**2)
