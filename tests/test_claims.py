"""Tables of documents, what their rows claim, and citations."""

from loomspark.operators import claims

TABLES = "cluster_id int, doc_id int, doc_kind string, artifact string, section_id string, section_title string, line int, headers array<string>, cells array<string>"


def test_tables_of_lines(spark):
    text = """intro
| not | a table of a section |
## 4.2 Steps
|Step | Program|
|---|---|
| S1 | P1 | beyond |
| S2 \\| x |

# Other  one
  | A |
text
| B |
|---|
| |
""".splitlines()
    lines = spark.createDataFrame([(d, k, x) for d in (1, 2) for k, x in enumerate(text, 1)] + [(3, 1, None)], "doc_id int, line int, text string").repartition(3)
    got = [(r.section_id, r.section_title, r.line, r.headers, r.cells) for r in claims.table_rows(lines).filter("doc_id = 1").orderBy("line").collect()]
    assert got == [("4.2", "4.2 Steps", 6, ["Step", "Program"], ["S1", "P1"]), ("4.2", "4.2 Steps", 7, ["Step", "Program"], ["S2 | x", ""]), ("other-one", "Other  one", 14, ["B"], [""])]


def row(doc, kind, artifact, line, headers, cells, cluster=1, title="t", section="4/s"):
    return (cluster, doc, kind, artifact, section, title, line, headers, cells)


def test_claims_by_kind(spark):
    cobol, jcl = "GEN.DD.COBOL-PAYROLL.report.md", "GEN.DD.JCL-NIGHT.report.md"
    tables = spark.createDataFrame([
        row(1, "dd_cobol", cobol, 1, ["No", "Called program", "Sites", "Status"], ["1", " taxcalc ", "L10 (x), L20,", ""]), row(1, "dd_cobol", cobol, 2, ["Called program", "Status"], ["SORT", ""]), row(1, "dd_cobol", cobol, 3, ["Called program"], [""]),
        row(1, "dd_cobol", cobol, 4, ["COPY member", "Source line"], ["rates.cpy", "L3"]), row(1, "dd_cobol", cobol, 5, ["Field", "PICTURE", "PIC"], ["Net-Pay (L7)", "", "s9(3)"]), row(1, "dd_cobol", cobol, 6, ["Field", "PIC", "Notes"], ["X", "9", "is truncated"]),
        row(2, "dd_jcl", jcl, 1, ["Step", "Program", "Parameters"], ["s1@L4", "payroll,x", "cond=(0,NE)"]), row(2, "dd_jcl", jcl, 2, ["DDName", "DSN", "DISP", "DCB"], ["in", "to PAY.IN now", "SHR", "LRECL=80 (L1)"], title="6.1 Step05 x"),
        row(2, "dd_jcl", jcl, 3, ["DDNAME", "Resource"], ["OUT", "console"], title="6.1", section="6/final"), row(2, "dd_jcl", jcl, 4, ["Step", "DDName"], ["x", "y"]),
        row(3, "bd", "GEN.BD-X.md", 1, ["Process", "Input", "Output"], ["STEP05 cleans up", "PAY.IN", "PAY.OUT and LOG.A"]), row(3, "bd", "GEN.BD-X.md", 2, ["Process", "Input"], ["idcams remove", "PAY.OLD"]), row(3, "bd", "GEN.BD-X.md", 3, ["Process", "Input"], ["by hand", "PAY.OLD"]),
        row(3, "bd", "GEN.BD-X.md", 4, ["Actor", "Role"], ["PAYROLL program", "main"]), row(3, "bd", "GEN.BD-X.md", 5, ["Actor"], ["Head of Pay!"]), row(3, "bd", "GEN.BD-X.md", 6, ["Dependency", "Resolution"], ["PAYROLL -> TAXCALC, RATES / IN (2 call sites)", "open"]),
        row(3, "bd", "GEN.BD-X.md", 7, ["Dependency", "Resolution"], ["payroll → NEWONE", "✓"]), row(3, "bd", "GEN.BD-X.md", 8, ["Dependency", "Resolution"], ["OTHER -> SORT", "✓"]), row(3, "bd", "GEN.BD-X.md", 9, ["Dependency", "Resolution"], ["payroll → SORT", ""]),
        row(4, "bd", "GEN.BD-Y.md", 1, ["Actor"], ["PAYROLL"], cluster=2), row(4, "dd_cobol", cobol, 2, None, None, cluster=3),
    ], TABLES)
    aliases = spark.createDataFrame([("pay.in", "REAL.PAY")], "alias string, dsn string")
    made = claims.table_claims(tables, "NIGHT", "PAY[A-Z]+", ("NET", "9", "GROSS", "99"), aliases)
    got = {(r.doc_id, r.line, r.predicate, r.subject, r.object, r.value, tuple(sorted(r.qualifiers.items())), r.status) for r in made.collect()}
    q = lambda **kv: tuple(sorted(kv.items()))
    p, dd = "program/PAYROLL", "dd/NIGHT.STEP05.IN"
    assert got == {
        (1, 1, "calls", p, "program/TAXCALC", "2", q(call_sites="L10,L20", resolution_status=""), "asserted"), (1, 2, "calls", p, "extroutine/SORT", "0", q(call_sites="", resolution_status=""), "external"), (1, 4, "copies", p, "copybook/RATES", "L3", (), "asserted"),
        (1, 5, "field_pic", "field/PAYROLL.NET-PAY", None, "S9(3)", (), "asserted"), (1, 5, "field_width_relation", "field/PAYROLL.NET", "field/PAYROLL.GROSS", "narrower_than", q(relation="narrower_than", dest_pic="9", src_pic="99"), "asserted"),
        (1, 6, "field_pic", "field/PAYROLL.X", None, "9", (), "asserted"), (1, 6, "field_width_relation", "field/PAYROLL.NET", "field/PAYROLL.GROSS", "narrower_than", q(relation="narrower_than", dest_pic="9", src_pic="99"), "asserted"),
        (2, 1, "runs", "job/NIGHT", "step/NIGHT.S1", None, q(cond_guard="COND=(0,NE)"), "asserted"), (2, 1, "runs", "step/NIGHT.S1", p, None, q(cond_guard="COND=(0,NE)"), "asserted"),
        (2, 2, "binds_dd", "step/NIGHT.STEP05", dd, None, q(dcb="LRECL=80", disp="SHR"), "asserted"), (2, 2, "binds_dd", dd, "dataset/REAL.PAY", None, q(mode="read", dcb="LRECL=80", disp="SHR"), "asserted"),
        (2, 2, "accesses", "step/NIGHT.STEP05", "dataset/REAL.PAY", None, q(mode="read", ddname="IN", dcb="LRECL=80", disp="SHR"), "asserted"), (2, 3, "binds_dd", "step/NIGHT.FINAL", "dd/NIGHT.FINAL.OUT", None, q(disp=""), "asserted"),
        (3, 1, "accesses", "step/NIGHT.STEP05", "dataset/REAL.PAY", None, q(mode="read", cell="PAY.IN"), "asserted"), (3, 1, "accesses", "step/NIGHT.STEP05", "dataset/PAY.OUT", None, q(mode="write", cell="PAY.OUT and LOG.A"), "asserted"),
        (3, 1, "accesses", "step/NIGHT.STEP05", "dataset/LOG.A", None, q(mode="write", cell="PAY.OUT and LOG.A"), "asserted"), (3, 2, "accesses", "extroutine/IDCAMS", "dataset/PAY.OLD", None, q(mode="write", cell="PAY.OLD"), "asserted"),
        (3, 4, "references", p, None, None, q(is_actor="true", role="main"), "asserted"), (3, 5, "references", "actor/head_of_pay", None, None, (), "asserted"), (3, 6, "copies", p, "copybook/RATES", None, (), "unresolved"),
        (3, 7, "calls", p, "program/NEWONE", None, (), "asserted"), (3, 9, "calls", p, "extroutine/SORT", None, (), "unresolved"), (4, 1, "references", "actor/payroll", None, None, (), "asserted"),
    }
    assert claims.table_claims(tables.limit(0), "NIGHT", "PAY").collect() == []


def test_rows_are_parsed_once(spark):
    """Every kind of claim reads one stored table of parsed cells instead of parsing the tables' rows anew."""
    tables = spark.createDataFrame([row(1, "dd_cobol", "GEN.DD.COBOL-P.report.md", 1, ["COPY member"], ["a.cpy"]), row(2, "bd", "GEN.BD-X.md", 1, ["Dependency"], ["P -> A"])], TABLES)
    made = claims.table_claims(tables, "NIGHT", "PAY")
    assert sorted((r.doc_id, r.predicate, r.object) for r in made.collect()) == [(1, "copies", "copybook/A"), (2, "copies", "copybook/A")]
    assert "headers" not in made._jdf.queryExecution().toString()


def test_citations_of_three_forms(spark):
    r = "GEN.DD.COBOL-A.report.md"
    texts = [f"{r} and {r} §4.2, {r} §9", f"{r} step 4.1/4.9", f"{r} STEP 4.1/5", f"{r} §3 Control-Flow", f"{r} §3 Controls", "GEN.DD.JCL-NO.report.md step 1", f"{r} §Title", None]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(texts)], "doc_id int, line int, text string")
    cites = claims.citations(lines)
    assert {(x.line, x.style, x.target) for x in cites.filter("line in (0, 1, 3)").collect()} == {(0, "section", None), (0, "section", "4.2"), (0, "section", "9"), (1, "section", None), (1, "step", "4.1"), (1, "step", "4.9"), (3, "section", "3"), (3, "unnumbered", "3 Control-Flow")}
    heads = spark.createDataFrame([(r, "4.2", "Files"), (r, "3/control-flow-narrative", "Control-Flow Narrative"), (r, "x", "3rd"), (r, "y", None)], "artifact string, section_id string, title string")
    steps = spark.createDataFrame([(r, "4.1"), (r, "5"), (r, "5")], "artifact string, step_id string")
    broken = claims.broken_citations(cites, heads.select("artifact"), heads, steps)
    assert {(x.line, x.style, x.target, x.missing) for x in broken.collect()} == {(0, "section", "9", "target"), (1, "step", "4.9", "target"), (4, "unnumbered", "3 Controls", "target"), (5, "section", None, "document"), (5, "step", "1", "document")}
    runs = spark.createDataFrame([(1, 1, "step", r, "4.1/5"), (1, 2, "step", r, "4.1/6"), (1, 3, "step", r, "4.1/4.1")], "doc_id int, line int, style string, target_doc string, target string")
    assert [x.target for x in claims.broken_citations(runs, heads.select("artifact"), heads, steps).collect()] == ["4.1/6"]
