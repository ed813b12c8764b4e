"""Call resolution over the given tables: parts are definitions, orders imports, customers attributes, line items calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import resolution as R
from loomspark.sources.tables import checkpoint, read

CLASSES, FILES = 125, 97


def _name(prefix: str, k: Column | str, n: int) -> Column:
    return F.concat(F.lit(prefix), (F.col(k) if isinstance(k, str) else k) % n)


def _file(k: Column) -> Column:
    """A file of the code; one is written with the other slash."""
    number = k % FILES
    return F.concat(F.when(number == 5, "src\\m").otherwise("src/m"), number, F.lit(".py"))


def code_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """definitions, imports, attributes, bases and calls, as resolution takes them."""
    k = F.col("p_partkey")
    own_class = F.concat(F.lit("C"), F.floor(k % (4 * CLASSES) / 4))
    class_name = F.when(k % 4 == 1, own_class)
    face = k % 8 == 3
    name = F.when((k % 4 == 0) & (k < 4 * CLASSES), own_class).when(k % 4 == 0, F.concat(F.lit("D"), k)).when(k % 4 == 1, _name("m", k, 7)).when(k % 4 == 2, _name("f", k, 40)).when(face, _name("I", k, 5)).otherwise(_name("g", k, 30))
    kind = F.when(k % 4 == 0, "class").when(k % 4 == 1, "method").when((k % 4 == 3) & face, "interface").otherwise("function")
    d = read(spark, sf_dir, "part").select(_file(k).alias("file"), name.alias("name"), kind.alias("kind"), class_name.alias("class_name"), k.alias("pos"))
    d = checkpoint(d.withColumn("fqn", F.concat("file", F.lit("::"), F.when(F.col("class_name").isNotNull(), F.concat("class_name", F.lit("."))).otherwise(""), "name")))

    h = F.when(F.col("pos") < 4 * CLASSES, F.floor(F.col("pos") / 4))
    pos = F.col("pos")
    tried = F.array(
        F.when(h > 0, F.concat(F.lit("C"), F.floor(h / 2))).when(h.isNull(), _name("C", pos, CLASSES)),
        F.when((h > 0) & (pos % 3 == 0), F.concat(F.lit("C"), F.floor(h / 3))),
        F.when(F.when(h.isNull(), pos % 3 == 0).otherwise(pos % 8 == 0), _name("I", pos, 5)),
    )
    bases = d.filter("kind = 'class'").select("file", F.col("name").alias("class_name"), pos, F.posexplode(tried).alias("_n", "base")).filter("base is not null").select("file", "class_name", "base", (pos * 4 + F.col("_n")).alias("pos"))

    o, x = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 7)
    case = lambda *values: F.element_at(F.array(*values), (o % 7 + 1).cast("int"))
    none, star = F.lit(None).cast("string"), (o % 7 == 5) & (x % 300 == 0)
    module = F.concat(F.lit("m"), x % FILES, F.lit(".py"))
    local = case(_name("f", x, 40), _name("mod", x, 20), _name("T", x, 25), _name("g", x, 30), _name("al", x, 15), F.when(star, "*").otherwise(_name("g", x, 30)), none)
    src = case(module, F.concat(F.lit("src/"), module), module, none, F.concat(F.lit("deep/src/"), module), module, none)
    orig = case(none, none, _name("C", x, CLASSES), none, _name("f", x, 40), none, none)
    imports = read(spark, sf_dir, "orders").select(_file(F.col("o_custkey")).alias("file"), local.alias("local_name"), src.alias("src_file"), orig.alias("orig_name"), star.alias("is_star"), o.alias("pos")).filter("local_name is not null")

    c, methods = F.col("c_custkey"), d.filter("kind = 'method'")
    many = methods.count()
    numbered = methods.select("file", "class_name", "name", F.floor(pos / 4).alias("slot"))
    typed = F.when(c % 3 == 0, _name("C", c, CLASSES)).when(c % 3 == 1, _name("T", c, 25)).otherwise(_name("I", c, 5))
    given = read(spark, sf_dir, "customer").select(c.alias("pos"), (c % max(1, many)).alias("slot"), _name("a", F.floor(c / 3), 3).alias("attr_name"), typed.alias("assigned_type"), (c % 3 < 2).alias("is_construction"), (c % 5 == 0).alias("_outside"))
    attributes = given.join(numbered, "slot").select("file", "class_name", F.when(~F.col("_outside"), F.col("name")).alias("method_name"), "attr_name", "assigned_type", "is_construction", "pos")

    n = F.col("l_orderkey")
    form = F.col("l_suppkey") % 5
    called = F.element_at(F.array(_name("f", n, 40), _name("al", n, 15), _name("g", n, 30), _name("m", n, 7)), (n % 4 + 1).cast("int"))
    method = F.when(form < 2, called).when(form == 4, _name("f", n, 40)).otherwise(_name("m", n, 7))
    receiver = F.when(form == 2, "self").when(form == 3, F.concat(F.lit("self."), _name("a", n, 3))).when(form == 4, _name("mod", n, 20))
    lines = read(spark, sf_dir, "lineitem").select((n * 8 + F.col("l_linenumber")).alias("call_id"), F.col("l_partkey").alias("pos"), receiver.alias("receiver"), method.alias("method"), F.col("l_linenumber").cast("int").alias("line"))
    calls = lines.join(d.filter("kind in ('method', 'function')").select("pos", F.col("fqn").alias("src"), "file"), "pos").drop("pos")
    return {"calls": calls, "definitions": d, "imports": imports, "attributes": attributes, "bases": bases}


def symbol_edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges between symbols: calls by imports, files, classes' ancestors and attributes' types, bases and constructions."""
    return R.symbol_edges(**code_tables(spark, sf_dir))


def inherited_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every class and method name the first definition along the class's bases, depth first."""
    t = code_tables(spark, sf_dir)
    names = t["definitions"].filter("kind = 'method'").select(F.col("name").alias("method")).distinct()
    wanted = t["bases"].select("class_name").distinct().withColumn("method", F.explode(F.array(*(F.lit(f"m{i}") for i in range(7))))).join(names, "method", "left_semi")
    return R.methods_of(wanted, t["definitions"], t["bases"])


_FILE = lambda k: f"(CASE WHEN {k} % 97 = 5 THEN 'src\\m' ELSE 'src/m' END || ({k} % 97) || '.py')"
_CODE = f"""
d0 AS (
  SELECT {_FILE("p_partkey")} AS file, p_partkey AS pos, p_partkey AS k,
    CASE WHEN k % 4 = 0 AND k < 500 THEN 'C' || (k % 500 // 4) WHEN k % 4 = 0 THEN 'D' || k WHEN k % 4 = 1 THEN 'm' || (k % 7) WHEN k % 4 = 2 THEN 'f' || (k % 40) WHEN k % 8 = 3 THEN 'I' || (k % 5) ELSE 'g' || (k % 30) END AS name,
    CASE WHEN k % 4 = 0 THEN 'class' WHEN k % 4 = 1 THEN 'method' WHEN k % 8 = 3 THEN 'interface' ELSE 'function' END AS kind,
    CASE WHEN k % 4 = 1 THEN 'C' || (k % 500 // 4) END AS class_name
  FROM part
), d1 AS (SELECT *, file || '::' || coalesce(class_name || '.', '') || name AS fqn FROM d0),
d AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY fqn ORDER BY pos) = 1),
b AS (
  SELECT file, name AS class_name, pos * 4 + n AS pos, base FROM (
    SELECT *, unnest(bs) AS base, generate_subscripts(bs, 1) - 1 AS n FROM (
      SELECT file, name, pos, [
        CASE WHEN pos < 500 AND pos // 4 > 0 THEN 'C' || (pos // 4 // 2) WHEN pos >= 500 THEN 'C' || (pos % 125) END,
        CASE WHEN pos < 500 AND pos // 4 > 0 AND pos % 3 = 0 THEN 'C' || (pos // 4 // 3) END,
        CASE WHEN pos >= 500 AND pos % 3 = 0 OR pos < 500 AND pos % 8 = 0 THEN 'I' || (pos % 5) END] AS bs
      FROM d1 WHERE kind = 'class')) WHERE base IS NOT NULL
), im0 AS (
  SELECT {_FILE("o_custkey")} AS file, o_orderkey AS pos, o_orderkey % 7 AS c, o_orderkey // 7 AS x FROM orders
), im AS (
  SELECT file, pos, CASE c WHEN 0 THEN 'f' || (x % 40) WHEN 1 THEN 'mod' || (x % 20) WHEN 2 THEN 'T' || (x % 25) WHEN 3 THEN 'g' || (x % 30) WHEN 4 THEN 'al' || (x % 15) ELSE CASE WHEN x % 300 = 0 THEN '*' ELSE 'g' || (x % 30) END END AS local_name,
    CASE c WHEN 3 THEN NULL WHEN 1 THEN 'src/m' || (x % 97) || '.py' WHEN 4 THEN 'deep/src/m' || (x % 97) || '.py' ELSE 'm' || (x % 97) || '.py' END AS src_file,
    CASE c WHEN 2 THEN 'C' || (x % 125) WHEN 4 THEN 'f' || (x % 40) END AS orig_name, c = 5 AND x % 300 = 0 AS is_star
  FROM im0 WHERE c < 6
), nm AS (SELECT * FROM im QUALIFY row_number() OVER (PARTITION BY file, local_name ORDER BY pos DESC) = 1),
st AS (SELECT DISTINCT file FROM im WHERE is_star),
me AS (SELECT file, class_name, name, pos // 4 AS slot FROM d1 WHERE kind = 'method'),
atr AS (
  SELECT me.file, me.class_name, CASE WHEN c_custkey % 5 <> 0 THEN me.name END AS method_name, 'a' || (c_custkey // 3 % 3) AS attr_name, c_custkey % 3 < 2 AS is_construction,
    CASE c_custkey % 3 WHEN 0 THEN 'C' || (c_custkey % 125) WHEN 1 THEN 'T' || (c_custkey % 25) ELSE 'I' || (c_custkey % 5) END AS assigned_type
  FROM customer JOIN me ON me.slot = c_custkey % (SELECT count(*) FROM me)
), ca AS (
  SELECT l_orderkey * 8 + l_linenumber AS call_id, d1.fqn AS src, d1.file, d1.class_name, CAST(l_linenumber AS INTEGER) AS line, l_suppkey % 5 AS form,
    CASE l_suppkey % 5 WHEN 2 THEN 'self' WHEN 3 THEN 'a' || (l_orderkey % 3) WHEN 4 THEN 'mod' || (l_orderkey % 20) END AS receiver,
    CASE WHEN l_suppkey % 5 IN (2, 3) THEN 'm' || (l_orderkey % 7) WHEN l_suppkey % 5 = 4 THEN 'f' || (l_orderkey % 40)
      ELSE CASE l_orderkey % 4 WHEN 0 THEN 'f' || (l_orderkey % 40) WHEN 1 THEN 'al' || (l_orderkey % 15) WHEN 2 THEN 'g' || (l_orderkey % 30) ELSE 'm' || (l_orderkey % 7) END END AS method
  FROM lineitem JOIN d1 ON d1.pos = l_partkey WHERE d1.kind IN ('method', 'function')
), bn AS (
  SELECT class_name, base, row_number() OVER (PARTITION BY class_name ORDER BY min(pos)) - 1 AS n FROM b GROUP BY class_name, base
), an AS (
  SELECT class_name, class_name AS ancestor, CAST([] AS BIGINT[]) AS path, [class_name] AS seen FROM (SELECT class_name FROM d1 WHERE kind = 'method' UNION SELECT class_name FROM b UNION SELECT base FROM b UNION SELECT assigned_type FROM atr UNION SELECT orig_name FROM im)
  UNION ALL
  SELECT an.class_name, bn.base, list_append(path, n), list_append(seen, base) FROM an JOIN bn ON bn.class_name = an.ancestor WHERE len(path) < 20 AND NOT list_contains(seen, base)
), ow AS (SELECT class_name, name AS method, fqn FROM d WHERE class_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY class_name, name ORDER BY pos) = 1),
mr AS (SELECT an.class_name, ow.method, ow.fqn AS dst FROM an JOIN ow ON ow.class_name = an.ancestor QUALIFY row_number() OVER (PARTITION BY an.class_name, ow.method ORDER BY path) = 1)"""
_EDGES = """
wi AS (
  SELECT call_id, src, line, src_file, coalesce(orig_name, method) AS name FROM ca JOIN nm ON nm.file = ca.file AND nm.local_name = ca.method WHERE form < 2 AND NOT is_star AND ca.file NOT IN (SELECT file FROM st)
  UNION ALL SELECT call_id, src, line, src_file, method FROM ca JOIN nm ON nm.file = ca.file AND nm.local_name = ca.receiver WHERE form = 4 AND NOT is_star
), tf AS (SELECT fqn, name, pos, replace(file, chr(92), '/') AS file FROM d WHERE class_name IS NULL),
ex AS (
  SELECT w.src_file, w.name, tf.fqn AS dst FROM (SELECT DISTINCT src_file, name FROM wi WHERE src_file IS NOT NULL) w JOIN tf ON tf.name = w.name AND (tf.file = w.src_file OR ends_with(tf.file, '/' || w.src_file) OR ends_with(w.src_file, '/' || tf.file))
  QUALIFY row_number() OVER (PARTITION BY w.src_file, w.name ORDER BY tf.pos) = 1
), lo AS (SELECT file, name, min(fqn) AS dst FROM d GROUP BY file, name HAVING count(*) = 1),
fa AS (SELECT DISTINCT name FROM d WHERE kind = 'interface'),
ty AS (
  SELECT t.file, t.class_name, t.attr_name, coalesce(nm.orig_name, t.assigned_type) AS resolved, count(*) OVER (PARTITION BY t.file, t.class_name, t.attr_name) AS n
  FROM (SELECT DISTINCT file, class_name, attr_name, assigned_type FROM atr) t LEFT JOIN nm ON nm.file = t.file AND nm.local_name = t.assigned_type AND NOT nm.is_star
), cl AS (SELECT base, class_name, count(*) OVER (PARTITION BY base) AS n FROM (SELECT DISTINCT file, class_name, base FROM b)),
ak AS (
  SELECT call_id, src, line, method, class_name, 'self' AS kind, 1 AS n FROM ca WHERE form = 2 AND class_name IS NOT NULL
  UNION ALL SELECT call_id, src, line, method, resolved, 'type', ty.n FROM ca JOIN ty ON ty.file = ca.file AND ty.class_name = ca.class_name AND ty.attr_name = ca.receiver WHERE form = 3 AND resolved NOT IN (SELECT name FROM fa)
  UNION ALL SELECT call_id, src, line, method, cl.class_name, 'face', cl.n FROM ca JOIN ty ON ty.file = ca.file AND ty.class_name = ca.class_name AND ty.attr_name = ca.receiver JOIN cl ON cl.base = resolved WHERE form = 3 AND resolved IN (SELECT name FROM fa)
), ev AS (
  SELECT call_id, src, dst, 'calls' AS edge_type, 0.95 AS confidence, 'import_path_match' AS resolution_method, line FROM wi JOIN ex USING (src_file, name)
  UNION ALL SELECT call_id, src, dst, 'calls', 0.85, 'same_file_scope', line FROM ca JOIN lo ON lo.file = ca.file AND lo.name = ca.method
    WHERE form < 2 AND ca.file NOT IN (SELECT file FROM st) AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.file = ca.file AND nm.local_name = ca.method)
  UNION ALL SELECT call_id, src, dst, 'calls', CASE WHEN kind = 'self' THEN 0.9 WHEN kind = 'type' AND n = 1 THEN 0.85 ELSE greatest(0.15, 0.6 / n) END,
    CASE WHEN kind = 'self' THEN 'mro_resolved' WHEN kind = 'type' AND n = 1 THEN 'constructor_type_trace' ELSE 'name_heuristic_ambiguous' END, line FROM ak JOIN mr USING (class_name, method)
), oc AS (SELECT name AS resolved, min(fqn) AS dst FROM d WHERE kind IN ('class', 'interface') AND class_name IS NULL GROUP BY name HAVING count(*) = 1),
al AS (
  SELECT * FROM ev
  UNION ALL SELECT NULL, b.file || '::' || b.class_name, oc.dst, 'extends', 1.0, 'inheritance', NULL FROM (SELECT DISTINCT file, class_name, base FROM b) b LEFT JOIN nm ON nm.file = b.file AND nm.local_name = b.base AND NOT nm.is_star JOIN oc ON oc.resolved = coalesce(nm.orig_name, b.base)
  UNION ALL SELECT NULL, t.file || '::' || t.class_name || '.' || coalesce(method_name, '__init__'), oc.dst, 'instantiates', 1.0, 'constructor_type_trace', NULL FROM (SELECT DISTINCT file, class_name, method_name, assigned_type FROM atr WHERE is_construction) t LEFT JOIN nm ON nm.file = t.file AND nm.local_name = t.assigned_type AND NOT nm.is_star JOIN oc ON oc.resolved = coalesce(nm.orig_name, t.assigned_type)
)"""
ORACLES = {
    "symbol_edge_rows": f"""WITH RECURSIVE {_CODE}, {_EDGES}
SELECT src, dst, edge_type, CAST(confidence AS DOUBLE) AS confidence, resolution_method, line FROM al
QUALIFY row_number() OVER (PARTITION BY src, dst, edge_type, confidence >= 0.7 ORDER BY call_id, confidence DESC, resolution_method) = 1""",
    "inherited_methods": f"WITH RECURSIVE {_CODE} SELECT class_name, method, dst FROM mr WHERE class_name IN (SELECT class_name FROM b)",
}
QUERIES = {f.__name__: f for f in (symbol_edge_rows, inherited_methods)}
