"""Design documents' tables, claims, citations and checks over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import claims, reconcile
from loomspark.sources.tables import checkpoint, read

PROGRAMS = r"PGM\d+"
NARROW = ("FLD-1", "9(9).99-", "FLD-2", "S9(10)V99")
_ARTIFACTS = ("GEN.DD.COBOL-PGM", "GEN.DD.JCL-JB", "GEN.BD-N")


def _pick(k: Column, *values: Column | str) -> Column:
    return F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), (k % len(values) + 1).cast("int"))


def _cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _three(k: Column, n: int) -> Column:
    return F.lpad((k % n).cast("string"), 3, "0")


def design_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of design documents' tables: orders are documents, which of eight tables a part's number tells."""
    o, p, s, n = (F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey", "linenumber"))
    pgm, dsn = _cat("PGM", _three(s, 80)), _cat("AA.BB", s % 20, ".CC")
    h = lambda *names: F.array(*map(F.lit, names))
    headers = [
        (h("Called program", "Call sites", "Resolved?"), h("COPY member", "Source line", "x"), h("Field Name", "PIC", "Notes")),
        (h("Step", "Program", "Key Parameters"), h("DDName", "DSN", "DISP", "DCB"), h("DDNAME", "Dataset / Resource", "Disposition", "Note")),
        (h("Stage", "Process", "Input", "Output", "Evidence"), h("Actor", "Role", "y"), h("Dependency", "Resolution")),
    ]
    data = _pick(s, _cat("see ", dsn), _cat("x", s), _cat(dsn, " and ZZ.Q1"))
    cells = [
        (
            F.array(F.when(s % 7 == 0, "sort").otherwise(F.lower(pgm)), _pick(n, "", _cat("L", p), _cat("L", p, " (main), L", s)), _pick(p, "✓", "✗ unresolved", "External", "")),
            F.array(_cat("Cb", s % 30, ".cpy"), _cat("L", p), F.lit("")),
            F.array(_cat("fld-", s % 9, _pick(n, "", " (L12)")), F.when(s % 9 == 5, "").otherwise(_cat("x(", n, ")")), F.when(p % 11 == 0, "Truncated").otherwise(_cat("L", p, " note"))),
        ),
        (
            F.array(_pick(p, _cat("step0", n, " (x)"), _cat("DELDEF1@L", n), _cat("Run", n)), F.when(s % 6 == 0, "idcams").otherwise(_cat(F.lower(pgm), ", parm")), F.when(p % 2 == 1, "Cond=(4,lt) x").otherwise("")),
            F.array(_cat("dd", s % 12), data, _pick(p, "NEW,CATLG", "SHR", "(MOD,DELETE)", "old"), _pick(n, "LRECL=80,RECFM=FB (L4)", "", "BLKSIZE=0")),
            F.array(F.when(n % 5 == 0, "").otherwise(_cat("DD", s % 12)), data, _pick(p, "WRITE", "SHR"), F.lit("-")),
        ),
        (
            F.array(_pick(n, _cat("STEP0", n), "stage"), _pick(p, _cat("run pgm", _three(s, 80), " now"), "Delete by sort", "nothing"), data, _pick(p, _cat("OUT.N", s % 9), "none", "A.B and GEN.REPORT.MD"), F.lit("L1")),
            F.array(_pick(p, _cat(pgm, " batch"), _cat("Bank Clerk #", s % 5), "..."), _cat("role ", n), F.lit("")),
            F.array(_pick(p, _cat("pgm", _three(s, 80), " -> PGM", _three(p, 80), ", CB", p % 40, " / DD", p % 15, " (", n, " call sites)"), _cat(pgm, " → SORT"), _cat("X.", pgm, " -> A"), _cat(pgm, "/x --> Q", p % 50)), _pick(n, "✓", "open", "Resolved")),
        ),
    ]
    kind, items, tables = o % 3, read(spark, sf_dir, "lineitem"), None
    for i in range(3):  # a branch for each table keeps its expressions small and their headers constant
        for j in range(3):
            rows = items.filter((kind == i) & (p % 3 == j)).select(
                (o % 5).alias("cluster_id"), o.alias("doc_id"), F.lit(("dd_cobol", "dd_jcl", "bd")[i]).alias("doc_kind"), _cat(_ARTIFACTS[i], _three(o, (40, 20, 9)[i]), ".report.md").alias("artifact"),
                _pick(s, _cat("4/part-", n), "5/y").alias("section_id"), (_cat("DDs of step0", p % 9, " now"), F.lit(""), F.lit("6.1 x y"))[j].alias("section_title"), n.alias("line"), headers[i][j].alias("headers"), cells[i][j].alias("cells"),
            )
            tables = rows if tables is None else tables.unionByName(rows)
    number = _pick(kind, _three(o, 40), _three(o, 20), _three(o, 9))
    bare = items.filter(~F.coalesce(kind.isin(0, 1, 2) & (p % 3).isin(0, 1, 2), F.lit(False))).select(  # in no table, yet of a document
        (o % 5).alias("cluster_id"), o.alias("doc_id"), _pick(kind, "dd_cobol", "dd_jcl", "bd").alias("doc_kind"), _cat(_pick(kind, *_ARTIFACTS), number, ".report.md").alias("artifact"), F.lit(None).cast("string").alias("section_id"),
        F.lit(None).cast("string").alias("section_title"), n.alias("line"), F.lit(None).cast("array<string>").alias("headers"), F.lit(None).cast("array<string>").alias("cells"),
    )
    return tables.unionByName(bare)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = read(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 1").select(_cat("aa.bb", F.col("s_suppkey") % 20, ".cc").alias("alias"), _cat("REAL.D", F.col("s_suppkey") % 20).alias("dsn"))
    return claims.table_claims(design_tables(spark, sf_dir), "JB000", PROGRAMS, NARROW, aliases)


def table_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every row of the designs' tables claims, by kind, with its qualifiers in order of their names."""
    shown = F.array_join(F.transform(F.sort_array(F.map_entries("qualifiers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return _claims(spark, sf_dir).withColumn("qualifiers", shown)


def document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables of Markdown documents: orders are documents, each line item three of its lines."""
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    bar = lambda k: _cat("| a", k, " | b\\|", k % 7, " |")
    texts = _pick(p, F.array(_cat("## ", n, ". Part ", p % 5), F.lit("|H1| H 2 |H3|"), F.lit("|---|:-:|---|")), F.array(bar(p), _cat(" ", bar(p + 1), "  "), F.lit("text | no table")), F.array(F.lit("| lone |"), F.lit("|-|"), _cat("|", p, "|x|y|")), F.array(_cat("# Über the Part ", p % 5), bar(p), F.lit("")))
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    lines = items.select(F.col("l_orderkey").alias("doc_id"), n.alias("_n"), F.posexplode(texts).alias("_k", "text")).select("doc_id", (F.col("_n") * 3 + F.col("_k")).alias("line"), "text")
    rows = claims.table_rows(lines)
    return rows.select("doc_id", "section_id", "section_title", "line", F.array_join("headers", "~").alias("headers"), F.array_join("cells", "~").alias("cells"))


def _report(k: Column) -> Column:
    return _cat("GEN.DD.COBOL-PG", k % 30, ".report.md")


def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in lines (of line items) of reports, sections, runs of steps and numbered headings (of parts) that lead nowhere."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    said = _pick(s, _cat(" §", n, ".", p % 3), _cat(" Step ", n, ".1/", p % 5, ".2 or"), _cat(" §", n, " Purpose-", p % 4), " §7", "")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("line"), _cat("see ", _report(p), said, " and ", _report(s), " end").alias("text"))
    part = read(spark, sf_dir, "part").filter("p_partkey % 30 < 25")
    k, z = F.col("p_partkey"), F.col("p_size")
    documents = part.select(_report(k).alias("artifact"))
    headings = part.select(_report(k).alias("artifact"), _pick(k, _cat(k % 7, ".", z % 3), _cat(k % 6, "/purpose-", z % 4, "-more")).alias("section_id"), _cat(z % 9, ". Title").alias("title"))
    steps = part.select(_report(k).alias("artifact"), F.explode(F.array(_cat(k % 7, ".1"), _cat(z % 5, ".2"))).alias("step_id"))
    return claims.broken_citations(checkpoint(claims.citations(lines)), documents, headings, steps)


def _designs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Basic designs' relations (orders), detailed ones (lines), and the programs that steps run."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = lambda k: _pick(k, *reconcile.RELATIONS)
    bd = orders.select(o.alias("id"), kind(c).alias("predicate"), _pick(o, _cat("program/P", c), _cat("step/J.S", o % 900), _cat("job/J", c % 50)).alias("subject"), F.when(o % 17 != 0, _cat("dataset/D", c % 40)).alias("object"), _pick(o, "read", "write", "").alias("mode"))
    ok = F.col("l_orderkey")
    dd = lines.filter("l_linenumber <= 2").select((ok * 8 + F.col("l_linenumber")).alias("id"), kind(F.col("l_partkey")).alias("predicate"), _pick(ok, _cat("step/J.S", ok % 900), _cat("program/P", F.col("l_suppkey")), _cat("step/xP", F.col("l_partkey") % 70), _cat("job/J", F.col("l_suppkey") % 50)).alias("subject"), _cat("dd/x/D", F.col("l_partkey") % 40).alias("object"), F.when(F.col("l_returnflag") == "R", "write").when(F.col("l_returnflag") == "A", "read").alias("mode"), (F.col("l_linestatus") == "F").alias("definitive"))
    runs = orders.select(_cat("step/J.S", o % 900).alias("step"), _cat("program/P", c).alias("program")).filter("step like '%1'")
    return bd, dd, runs


def relationship_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic designs' relations (orders) against detailed ones (lines): five predicates, programs and the steps that run them."""
    return reconcile.relationship(*_designs(spark, sf_dir))


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatches of the relationship check by severity, kinds without any as 0."""
    found = reconcile.relationship_severities(*_designs(spark, sf_dir))
    return found.agg(*[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).cast("long").alias(s) for s in ("error", "warning", "info")])


def value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures, width relations and DCB clauses that orders (basic) and lines (detailed) give of the same thing."""
    o = F.col("o_orderkey")

    def given(df: DataFrame, ident: Column, k: Column, v: Column, swap: Column) -> DataFrame:
        kind = _pick(k, "field_pic", "field_width_relation", "binds_dd")
        clause = F.when(swap, _cat("RECFM=FB,LRECL=0", v % 3 + 80)).otherwise(_cat("LRECL=", v % 3 + 80, ", recfm=fb (L", v, ")"))
        return df.select(ident.alias("id"), kind.alias("predicate"), _cat("x/", k).alias("subject"), F.when(k % 3 == 1, _cat("y/", k % 2)).alias("object"), _cat(" X(", v % 4, ") ").alias("value"), F.create_map(F.lit("relation"), _pick(v, "narrower_than", "equal", ""), F.lit("dcb"), clause).alias("qualifiers"))

    bd = given(read(spark, sf_dir, "orders"), o, o, F.col("o_custkey"), F.col("o_custkey") % 2 == 0)
    dd = given(read(spark, sf_dir, "lineitem"), F.struct("l_linenumber", "l_partkey"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_partkey") % 2 == 0)
    return reconcile.value_checks(bd, dd)


_P = lambda k, *v: f"(CASE ({k}) % {len(v)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(v)) + " END)"
_Q = lambda *v: [f"'{x}'" for x in v]
_DESIGN = rf"""
x AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_orderkey % 5 AS cluster_id, l_orderkey % 3 AS k, l_partkey % 3 AS v FROM lineitem),
y AS (
  SELECT *, 'PGM' || lpad(CAST(s % 80 AS VARCHAR), 3, '0') AS pgm, 'AA.BB' || (s % 20) || '.CC' AS dsn,
    CASE k WHEN 0 THEN 'PGM' || lpad(CAST(o % 40 AS VARCHAR), 3, '0') WHEN 1 THEN 'JB' || lpad(CAST(o % 20 AS VARCHAR), 3, '0') END AS own,
    {_P("s", "'4/part-' || n", "'5/y'")} AS sid, {_P("p", "'DDs of step0' || (p % 9) || ' now'", "''", "'6.1 x y'")} AS title FROM x
), z AS (
  SELECT *, {_P("s", "'see ' || dsn", "'x' || s", "dsn || ' and ZZ.Q1'")} AS data, coalesce(nullif(regexp_extract(upper(title), '\b(STEP\d+|DELDEF\d+|[A-Z][A-Z0-9_-]{{2,}})\b'), ''), upper(list_last(string_split(sid, '/')))) AS place FROM y
), ut AS (SELECT unnest(['IDCAMS', 'SORT', 'IEFBR14', 'CEE3ABD', 'DFSORT', 'ICEGENER', 'IEBGENER']) AS u),
kn AS (
  SELECT cluster_id, name, bool_or(i = 'p') AS is_p, bool_or(i = 'c') AS is_c, bool_or(i = 'd') AS is_d FROM (
    SELECT cluster_id, own AS name, 'p' AS i FROM z WHERE k = 0
    UNION ALL SELECT cluster_id, CASE WHEN s % 7 = 0 THEN NULL END, 'x' FROM z WHERE false
    UNION ALL SELECT cluster_id, 'CB' || (s % 30), 'c' FROM z WHERE k = 0 AND v = 1
    UNION ALL SELECT cluster_id, pgm, 'p' FROM z WHERE k = 1 AND v = 0 AND s % 6 <> 0
    UNION ALL SELECT cluster_id, 'DD' || (s % 12), 'd' FROM z WHERE k = 1 AND (v = 1 OR v = 2 AND n % 5 <> 0)
  ) GROUP BY cluster_id, name
), called AS (
  SELECT *, CASE WHEN s % 7 = 0 THEN 'SORT' ELSE pgm END AS nm, {_P("n", "''", "'L' || p", "'L' || p || ',L' || s")} AS sites, {_P("p", *_Q("✓", "✗ unresolved", "External", ""))} AS res FROM z WHERE k = 0 AND v = 0
), fields AS (
  SELECT *, 'FLD-' || (s % 9) AS nm, 'X(' || n || ')' AS pic FROM z WHERE k = 0 AND v = 2 AND s % 9 <> 5
), steps AS (
  SELECT *, {_P("p", "'STEP0' || n", "'DELDEF1'", "'RUN' || n")} AS st, CASE WHEN s % 6 = 0 THEN 'extroutine/IDCAMS' ELSE 'program/' || pgm END AS does, CASE WHEN p % 2 = 1 THEN 'cond_guard=COND=(4,LT)' ELSE '' END AS qualifiers FROM z WHERE k = 1 AND v = 0
), dds AS (
  SELECT *, 'DD' || (s % 12) AS nm, upper(nullif(regexp_extract(data, '\b[A-Z][A-Z0-9]*(?:\.[A-Z0-9#$@-]{{1,8}})+\b'), '')) AS ds,
    CASE WHEN v = 1 THEN {_P("p", *_Q("NEW,CATLG", "SHR", "(MOD,DELETE)", "old"))} ELSE {_P("p", *_Q("WRITE", "SHR"))} END AS disp, CASE WHEN v = 1 THEN {_P("n", "'LRECL=80,RECFM=FB'", "NULL", "'BLKSIZE=0'")} END AS dcb
  FROM z WHERE k = 1 AND (v = 1 OR v = 2 AND n % 5 <> 0)
), ddm AS (SELECT *, CASE WHEN regexp_matches(upper(disp), 'NEW|MOD|WRITE') THEN 'write' ELSE 'read' END AS mode, coalesce('dcb=' || dcb || ';', '') AS dq FROM dds),
flow AS (
  SELECT *, {_P("n", "'STEP0' || n", "'stage'")} AS stage, {_P("p", "'run pgm' || lpad(CAST(s % 80 AS VARCHAR), 3, '0') || ' now'", "'Delete by sort'", "'nothing'")} AS process, {_P("p", "'OUT.N' || (s % 9)", "'none'", "'A.B and GEN.REPORT.MD'")} AS outp FROM z WHERE k = 2 AND v = 0
), fl AS (
  SELECT *, coalesce('step/JB000.' || upper(nullif(regexp_extract(process || ' ' || stage || ' ' || sid, '(?i)\b(STEP\d+|DELDEF\d+|[A-Z0-9_-]+@L\d+)\b'), '')),
    CASE WHEN regexp_matches(process, '(?i)\bpgm\d+\b') THEN 'program/' || pgm WHEN regexp_matches(process, '(?i)\bsort\b') THEN 'extroutine/SORT' END) AS subject FROM flow
), mv AS (
  SELECT *, unnest(regexp_extract_all(data, '\b[A-Z][A-Z0-9]*(?:\.[A-Z0-9#$@-]{{1,8}})+\b')) AS d, CASE WHEN contains(lower(process || ' ' || data), 'delete') THEN 'write' ELSE 'read' END AS mode, data AS cell FROM fl
  UNION ALL SELECT *, unnest(regexp_extract_all(outp, '\b[A-Z][A-Z0-9]*(?:\.[A-Z0-9#$@-]{{1,8}})+\b')), 'write', outp FROM fl
), act AS (SELECT *, {_P("p", "pgm || ' batch'", "'Bank Clerk #' || (s % 5)", "'...'")} AS actor FROM z WHERE k = 2 AND v = 1),
dep AS (
  SELECT *, {_P("p", "pgm", "pgm", "NULL", "pgm")} AS caller, {_P("n", *_Q("✓", "open", "Resolved"))} AS res, CASE WHEN p % 4 = 0 THEN CAST(n AS VARCHAR) END AS sites,
    unnest({_P("p", "['PGM' || lpad(CAST(p % 80 AS VARCHAR), 3, '0'), 'CB' || (p % 40), 'DD' || (p % 15)]", "['SORT']", "CAST([] AS VARCHAR[])", "['Q' || (p % 50)]")}) AS callee
  FROM z WHERE k = 2 AND v = 2
), dp AS (
  SELECT dep.*, res <> 'open' AS sure, is_p, is_c, is_d FROM dep LEFT JOIN kn ON kn.cluster_id = dep.cluster_id AND kn.name = callee WHERE EXISTS (SELECT 1 FROM kn q WHERE q.cluster_id = dep.cluster_id AND q.name = caller AND q.is_p)
), c0 AS (
  SELECT cluster_id, o, 'dd' AS side, n, 'called' AS kind, 'calls' AS predicate, 'program/' || own AS subject, CASE WHEN res = 'External' OR nm = 'SORT' OR contains(res, '✗') THEN 'extroutine/' ELSE 'program/' END || nm AS object,
    CAST(CASE WHEN sites = '' THEN 0 ELSE len(string_split(sites, ',')) END AS VARCHAR) AS value, 'call_sites=' || sites || ';resolution_status=' || res AS qualifiers, CASE WHEN res = 'External' OR nm = 'SORT' THEN 'external' WHEN contains(res, '✗') THEN 'unresolved' ELSE 'asserted' END AS status FROM called
  UNION ALL SELECT cluster_id, o, 'dd', n, 'copied', 'copies', 'program/' || own, 'copybook/CB' || (s % 30), 'L' || p, '', 'asserted' FROM z WHERE k = 0 AND v = 1
  UNION ALL SELECT cluster_id, o, 'dd', n, 'field', 'field_pic', 'field/' || own || '.' || nm, NULL, pic, '', 'asserted' FROM fields
  UNION ALL SELECT cluster_id, o, 'dd', n, 'field', 'field_width_relation', 'field/' || own || '.FLD-1', 'field/' || own || '.FLD-2', 'narrower_than', 'dest_pic=9(9).99-;relation=narrower_than;src_pic=S9(10)V99', 'asserted' FROM fields WHERE contains(nm, 'FLD-1') OR contains(nm, 'FLD-2') OR p % 11 = 0
  UNION ALL SELECT cluster_id, o, 'dd', n, 'step', 'runs', 'job/' || own, 'step/' || own || '.' || st, NULL, qualifiers, 'asserted' FROM steps
  UNION ALL SELECT cluster_id, o, 'dd', n, 'step', 'runs', 'step/' || own || '.' || st, does, NULL, qualifiers, CASE WHEN s % 6 = 0 THEN 'external' ELSE 'asserted' END FROM steps
  UNION ALL SELECT cluster_id, o, 'dd', n, 'dd', 'binds_dd', 'step/' || own || '.' || place, 'dd/' || own || '.' || place || '.' || nm, NULL, dq || 'disp=' || disp, 'asserted' FROM ddm
  UNION ALL SELECT cluster_id, o, 'dd', n, 'dd', 'binds_dd', 'dd/' || own || '.' || place || '.' || nm, 'dataset/' || ds, NULL, dq || 'disp=' || disp || ';mode=' || mode, 'asserted' FROM ddm WHERE ds IS NOT NULL
  UNION ALL SELECT cluster_id, o, 'dd', n, 'dd', 'accesses', 'step/' || own || '.' || place, 'dataset/' || ds, NULL, dq || 'ddname=' || nm || ';disp=' || disp || ';mode=' || mode, 'asserted' FROM ddm WHERE ds IS NOT NULL
  UNION ALL SELECT cluster_id, o, 'bd', n, 'flow', 'accesses', subject, 'dataset/' || d, NULL, 'cell=' || cell || ';mode=' || mode, 'asserted' FROM mv WHERE subject IS NOT NULL AND NOT ends_with(d, '.REPORT.MD')
  UNION ALL SELECT act.cluster_id, o, 'bd', n, 'actor', 'references', CASE WHEN kn.name IS NOT NULL THEN 'program/' || kn.name ELSE 'actor/' || replace(lower(regexp_replace(actor, '[^\w\s-]', '', 'g')), ' ', '_') END, NULL, NULL, CASE WHEN kn.name IS NOT NULL THEN 'is_actor=true;role=role ' || n ELSE '' END, 'asserted'
    FROM act LEFT JOIN kn ON kn.cluster_id = act.cluster_id AND kn.is_p AND kn.name = regexp_extract(actor, '\b[A-Z0-9]{{6,8}}\b') WHERE actor <> '...'
  UNION ALL SELECT cluster_id, o, 'bd', n, 'dependency', CASE WHEN is_c THEN 'copies' ELSE 'calls' END, 'program/' || caller,
    CASE WHEN is_c THEN 'copybook/' WHEN is_p THEN 'program/' WHEN callee = 'SORT' THEN 'extroutine/' ELSE 'program/' END || callee, CASE WHEN is_c THEN NULL ELSE sites END, '', CASE WHEN sure THEN 'asserted' ELSE 'unresolved' END
    FROM dp WHERE is_c OR NOT coalesce(is_d, false) AND (is_p OR callee = 'SORT' OR sure)
), al AS (SELECT DISTINCT 'dataset/AA.BB' || (s_suppkey % 20) || '.CC' AS a, 'dataset/REAL.D' || (s_suppkey % 20) AS b FROM supplier WHERE s_suppkey % 4 = 1)"""
_CITED = r"""
x AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS line, 'see GEN.DD.COBOL-PG' || (l_partkey % 30) || '.report.md' || CASE l_suppkey % 5 WHEN 0 THEN ' §' || l_linenumber || '.' || (l_partkey % 3) WHEN 1 THEN ' Step ' || l_linenumber || '.1/' || (l_partkey % 5) || '.2 or' WHEN 2 THEN ' §' || l_linenumber || ' Purpose-' || (l_partkey % 4) WHEN 3 THEN ' §7' ELSE '' END
    || ' and GEN.DD.COBOL-PG' || (l_suppkey % 30) || '.report.md end' AS t FROM lineitem
), w AS (SELECT *, 'GEN\.DD\.(?:COBOL|JCL)-[A-Z0-9_-]+\.report\.md' AS r FROM x),
ci AS (
  SELECT doc_id, line, 'section' AS style, unnest(regexp_extract_all(t, '(GEN\.DD\.(?:COBOL|JCL)-[A-Z0-9_-]+\.report\.md)(?:\s+§(\d+(?:\.\d+)*))?', 1)) AS target_doc, nullif(unnest(regexp_extract_all(t, '(GEN\.DD\.(?:COBOL|JCL)-[A-Z0-9_-]+\.report\.md)(?:\s+§(\d+(?:\.\d+)*))?', 2)), '') AS target FROM x
  UNION ALL SELECT doc_id, line, 'step', target_doc, unnest(string_split(run, '/')) FROM (SELECT doc_id, line, unnest(regexp_extract_all(t, '(?i)(GEN\.DD\.(?:COBOL|JCL)-[A-Z0-9_-]+\.report\.md)\s+step\s+([\d.]+(?:/[\d.]+)*)', 1)) AS target_doc, unnest(regexp_extract_all(t, '(?i)(GEN\.DD\.(?:COBOL|JCL)-[A-Z0-9_-]+\.report\.md)\s+step\s+([\d.]+(?:/[\d.]+)*)', 2)) AS run FROM x)
  UNION ALL SELECT doc_id, line, 'unnumbered', target_doc, a || ' ' || b FROM (SELECT doc_id, line, unnest(regexp_extract_all(t, '(?i)(GEN\.DD\.(?:COBOL|JCL)-[A-Z0-9_-]+\.report\.md)\s+§(\d+)\s+([A-Za-z0-9_-]+)', 1)) AS target_doc, unnest(regexp_extract_all(t, '(?i)(GEN\.DD\.(?:COBOL|JCL)-[A-Z0-9_-]+\.report\.md)\s+§(\d+)\s+([A-Za-z0-9_-]+)', 2)) AS a, unnest(regexp_extract_all(t, '(?i)(GEN\.DD\.(?:COBOL|JCL)-[A-Z0-9_-]+\.report\.md)\s+§(\d+)\s+([A-Za-z0-9_-]+)', 3)) AS b FROM x)
), pt AS (SELECT *, 'GEN.DD.COBOL-PG' || (p_partkey % 30) || '.report.md' AS artifact FROM part WHERE p_partkey % 30 < 25),
hd AS (SELECT artifact, CASE p_partkey % 2 WHEN 0 THEN (p_partkey % 7) || '.' || (p_size % 3) ELSE (p_partkey % 6) || '/purpose-' || (p_size % 4) || '-more' END AS sid, (p_size % 9) || '. Title' AS title FROM pt),
sp AS (SELECT artifact, unnest([(p_partkey % 7) || '.1', (p_size % 5) || '.2']) AS step_id FROM pt)"""
_REL = """
r AS (SELECT DISTINCT 'step/J.S' || (o_orderkey % 900) AS st, 'program/P' || o_custkey AS pr FROM orders WHERE o_orderkey % 900 % 10 = 1),
b AS (SELECT * FROM (SELECT o_orderkey AS id, {k_c} AS predicate, {b_s} AS subject, CASE WHEN o_orderkey % 17 <> 0 THEN 'dataset/D' || (o_custkey % 40) END AS object, 'D' || (o_custkey % 40) AS tail, {b_m} AS mode FROM orders) WHERE object IS NOT NULL),
d AS (SELECT l_orderkey * 8 + l_linenumber AS id, {k_p} AS predicate, {d_s} AS subject, 'D' || (l_partkey % 40) AS tail, CASE l_returnflag WHEN 'R' THEN 'write' WHEN 'A' THEN 'read' END AS mode, l_linestatus = 'F' AS sure FROM lineitem WHERE l_linenumber <= 2),
m AS (
  SELECT b.id, d.id AS dd_id, b.subject, b.object, b.mode AS bm, d.mode AS dm, d.sure FROM b JOIN d ON b.predicate = d.predicate AND b.tail = d.tail AND (b.subject = d.subject
    OR starts_with(b.subject, 'program/') AND starts_with(d.subject, 'step/') AND (contains(upper(d.subject), substr(b.subject, 9)) OR EXISTS (SELECT 1 FROM r WHERE st = d.subject AND pr = b.subject))
    OR starts_with(b.subject, 'step/') AND starts_with(d.subject, 'program/') AND (contains(upper(b.subject), substr(d.subject, 9)) OR EXISTS (SELECT 1 FROM r WHERE st = b.subject AND pr = d.subject)))
), v AS (
  SELECT id, NULL AS dd_id, subject, object, 'unverified' AS mismatch_type, 'info' AS severity FROM b WHERE id NOT IN (SELECT id FROM m)
  UNION ALL SELECT id, dd_id, subject, object, CASE WHEN sure THEN 'relationship' ELSE 'unverified' END, CASE WHEN sure THEN 'error' ELSE 'info' END FROM m WHERE bm IN ('read', 'write') AND dm IN ('read', 'write') AND bm <> dm
)""".format(
    k_c=_P("o_custkey", *_Q(*reconcile.RELATIONS)), k_p=_P("l_partkey", *_Q(*reconcile.RELATIONS)), b_s=_P("o_orderkey", "'program/P' || o_custkey", "'step/J.S' || (o_orderkey % 900)", "'job/J' || (o_custkey % 50)"),
    b_m=_P("o_orderkey", "'read'", "'write'", "''"), d_s=_P("l_orderkey", "'step/J.S' || (l_orderkey % 900)", "'program/P' || l_suppkey", "'step/xP' || (l_partkey % 70)", "'job/J' || (l_suppkey % 50)"),
)
_GIVEN = lambda i, k, v, table: f"""SELECT {i} AS id, {k} % 3 AS c, 'x/' || {k} AS subject, CASE WHEN {k} % 3 = 1 THEN 'y/' || ({k} % 2) END AS object,
  CASE {k} % 3 WHEN 0 THEN 'X(' || ({v} % 4) || ')' WHEN 1 THEN nullif({_P(v, *_Q("narrower_than", "equal", ""))}, '') ELSE '{{"lrecl":"' || ({v} % 3 + 80) || '","recfm":"FB"}}' END AS value FROM {table}"""  # noqa: E731
_ROW = lambda k: rf"'| a' || ({k}) || ' | b\|' || (({k}) % 7) || ' |'"
ORACLES = {
    "table_assertions": f"WITH {_DESIGN} SELECT cluster_id, o AS doc_id, side, n AS line, kind, predicate, subject, coalesce(al.b, object) AS object, value, qualifiers, status FROM c0 LEFT JOIN al ON al.a = object",
    "document_tables": rf"""WITH it AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL), l0 AS (
  SELECT l_orderkey AS doc_id, l_linenumber * 3 AS base, unnest({_P("l_partkey", "['## ' || l_linenumber || '. Part ' || (l_partkey % 5), '|H1| H 2 |H3|', '|---|:-:|---|']", f"[{_ROW('l_partkey')}, ' ' || {_ROW('l_partkey + 1')} || '  ', 'text | no table']", "['| lone |', '|-|', '|' || l_partkey || '|x|y|']", f"['# Über the Part ' || (l_partkey % 5), {_ROW('l_partkey')}, '']")}) AS text, unnest([0, 1, 2]) AS k FROM it
), l1 AS (SELECT doc_id, base + k AS line, text, regexp_matches(text, '^\s*\|.+\|\s*$') AS bar, nullif(regexp_extract(text, '^#{{1,4}}\s+(.+?)\s*$', 1), '') AS head FROM l0),
l2 AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS title, bar AND NOT coalesce(lag(bar) OVER (PARTITION BY doc_id ORDER BY line), false) AS start,
  CASE WHEN bar THEN [replace(replace(trim(c), chr(1), '|'), chr(2), chr(92)) FOR c IN string_split(replace(regexp_replace(trim(text), '^\||\|$', '', 'g'), '\|', chr(1)), '|')] END AS cells FROM l1),
l3 AS (SELECT *, last_value(CASE WHEN start THEN cells END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS headers, coalesce(lag(start) OVER (PARTITION BY doc_id ORDER BY line), false) AS ruler FROM l2)
SELECT doc_id, coalesce(nullif(regexp_extract(title, '^(\d+(?:\.\d+)*)\.?\s', 1), ''), trim(regexp_replace(regexp_replace(lower(title), '[^a-zA-Z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-')) AS section_id, title AS section_title, line,
  array_to_string(headers, '~') AS headers, array_to_string([coalesce(cells[i], '') FOR i IN range(1, len(headers) + 1)], '~') AS cells FROM l3 WHERE bar AND NOT start AND NOT ruler""",
    "citation_check": f"""WITH {_CITED} SELECT DISTINCT doc_id, line, style, target_doc, target, 'document' AS missing FROM ci WHERE target_doc NOT IN (SELECT artifact FROM pt)
UNION ALL SELECT DISTINCT doc_id, line, style, target_doc, target, 'target' FROM ci WHERE target_doc IN (SELECT artifact FROM pt) AND target IS NOT NULL AND NOT CASE style
  WHEN 'section' THEN EXISTS (SELECT 1 FROM hd WHERE artifact = target_doc AND (sid = target OR starts_with(title, target)))
  WHEN 'step' THEN EXISTS (SELECT 1 FROM sp WHERE artifact = target_doc AND step_id = target)
  ELSE EXISTS (SELECT 1 FROM hd WHERE artifact = target_doc AND starts_with(sid, string_split(target, ' ')[1] || '/' || lower(string_split(target, ' ')[2]))) END""",
    "relationship_check": f"WITH {_REL} SELECT * FROM v",
    "severity_counts": f"WITH {_REL} SELECT count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM v",
    "value_checks": f"""WITH b AS ({_GIVEN("o_orderkey", "o_orderkey", "o_custkey", "orders")}), d AS ({_GIVEN("struct_pack(a := l_linenumber, b := l_partkey)", "l_orderkey", "l_partkey", "lineitem")}),
l AS (SELECT c, subject, coalesce(object, '') AS other, value AS dd_value FROM d WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c, subject, object ORDER BY id DESC) = 1)
SELECT id, b.subject, object, CASE b.c WHEN 0 THEN 'field_pic' WHEN 1 THEN 'field_width' ELSE 'dcb' END AS what, value, dd_value FROM b JOIN l ON l.c = b.c AND l.subject = b.subject AND l.other = coalesce(b.object, '') WHERE value IS NOT NULL AND value <> dd_value""",
}
QUERIES = {f.__name__: f for f in (table_assertions, document_tables, citation_check, relationship_check, severity_counts, value_checks)}
