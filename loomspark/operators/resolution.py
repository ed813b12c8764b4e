"""Resolution of call sites, bases and constructions to the symbols they mean.

Inputs are plain tables.  `pos` is a row's place in reading order; where a name could mean several rows, the first counts,
unless something else is said.

* definitions (fqn, file, name, kind, class_name, pos): class_name is null for what stands in a module itself; of rows with one fqn
  the first counts
* imports (file, local_name, src_file, orig_name, is_star, pos): of a file's imports of a name the last counts
* attributes (file, class_name, method_name, attr_name, assigned_type, is_construction, pos): types given to self.attr
* bases (file, class_name, base, pos)
* calls (call_id, src, file, receiver, method, line): in the order of call_id; receiver null, self, self.attr or a module
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.bm25 import small
from loomspark.sources.tables import checkpoint

#: How many steps of inheritance are followed.
MOST_BASES = 20
_EDGE = ("call_id", "src", "dst", "edge_type", "confidence", "resolution_method", "line")


def ambiguous(n: Column) -> Column:
    """The confidence of one of n possible targets."""
    return F.greatest(F.lit(0.15), 0.6 / F.greatest(F.lit(1), n))


def _slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def endings(path: Column) -> Column:
    """A path and what is left of it behind each of its slashes."""
    parts = F.split(_slashes(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def _first(df: DataFrame, by: list[str], what: list[str], order: str = "pos", last: bool = False) -> DataFrame:
    """For each value of `by` the row with the first (or last) place."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(*by).agg(pick(F.struct(*what), order).alias("_row")).select(*by, "_row.*")


def name_in(imports: DataFrame) -> DataFrame:
    """(file, local_name, src_file, orig_name, is_star): what a name of a file stands for."""
    return _first(imports, ["file", "local_name"], ["src_file", "orig_name", "is_star"], last=True)


def type_names(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """rows (file, column, ...) with `resolved`: the name under which the type was exported if the file imports it, else the name itself."""
    plain = names.filter("not is_star").select("file", F.col("local_name").alias(column), F.coalesce(F.nullif("orig_name", F.lit("")), "local_name").alias("_orig"))
    return rows.join(plain, ["file", column], "left").withColumn("resolved", F.coalesce("_orig", column)).drop("_orig")


def exported(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """(src_file, name, dst): the first symbol of a module itself that has the name in a file that src_file means.

    Two paths mean one file when one is the end of the other.
    """
    asked = wanted.select("src_file", "name").distinct()
    top = definitions.filter("class_name is null").select("fqn", "name", "pos", F.col("file").alias("_file"))
    by_ending = top.select("fqn", "name", "pos", F.explode(endings(F.col("_file"))).alias("_key"))
    exact = asked.withColumn("_key", _slashes(F.col("src_file"))).join(by_ending, ["name", "_key"])
    shorter = asked.select("src_file", "name", F.explode(endings(F.col("src_file"))).alias("_key")).join(top.select("fqn", "name", "pos", _slashes(F.col("_file")).alias("_key")), ["name", "_key"])
    return _first(exact.select("src_file", "name", "fqn", "pos").union(shorter.select("src_file", "name", "fqn", "pos")), ["src_file", "name"], ["fqn"]).withColumnRenamed("fqn", "dst")


def ancestors(classes: DataFrame, bases: DataFrame, most: int = MOST_BASES) -> DataFrame:
    """(class_name, ancestor, path): all that the classes inherit from, themselves included, up to `most` steps.

    path holds the numbers of the bases taken; paths in order are the order in which a search from base to base, depth first,
    meets the ancestors.  A path goes on only if no path that is as short comes earlier to the same ancestor, so that each step adds
    few rows whatever the shape, and cycles end.
    """
    numbered = bases.groupBy("class_name", "base").agg(F.min("pos").alias("pos")).groupBy("class_name").agg(F.sort_array(F.collect_list(F.struct("pos", "base"))).alias("_b"))
    steps = checkpoint(numbered.select(F.col("class_name").alias("ancestor"), F.posexplode("_b").alias("_n", "_base")).select("ancestor", F.col("_base.base").alias("base"), "_n"))
    found = edge = checkpoint(classes.select("class_name").distinct().select("class_name", F.col("class_name").alias("ancestor"), F.array().cast("array<int>").alias("path")))
    for _ in range(most):
        further = edge.join(steps, "ancestor").select("class_name", F.col("base").alias("ancestor"), F.concat("path", F.array("_n")).alias("path"))
        further = further.groupBy("class_name", "ancestor").agg(F.min("path").alias("path"))
        before = found.groupBy("class_name", "ancestor").agg(F.min("path").alias("_seen"))
        edge = checkpoint(further.join(before, ["class_name", "ancestor"], "left").filter("_seen is null or path < _seen").drop("_seen"))
        if edge.isEmpty():
            break
        found = checkpoint(found.union(edge))
    return found


def methods_of(wanted: DataFrame, definitions: DataFrame, bases: DataFrame, most: int = MOST_BASES) -> DataFrame:
    """(class_name, method, dst) for wanted (class_name, method): the method of the class or of the first ancestor that has it."""
    asked = checkpoint(wanted.select("class_name", "method").distinct())
    known = definitions.filter("class_name is not null").select(F.col("class_name").alias("ancestor"), F.col("name").alias("method"), "fqn", "pos")
    known = known.join(asked.select("method").distinct(), "method", "left_semi")
    own = _first(known, ["ancestor", "method"], ["fqn"])
    line = ancestors(asked, bases, most)
    met = asked.join(line, "class_name").join(own, ["ancestor", "method"])
    return met.groupBy("class_name", "method").agg(F.min_by("fqn", "path").alias("dst"))


def _edges(df: DataFrame, confidence: Column, method: Column, edge_type: str = "calls") -> DataFrame:
    return df.select("call_id", "src", "dst", F.lit(edge_type).alias("edge_type"), confidence.cast("double").alias("confidence"), method.alias("resolution_method"), "line")


def call_edges(calls: DataFrame, definitions: DataFrame, imports: DataFrame, attributes: DataFrame, bases: DataFrame) -> DataFrame:
    """(call_id, src, dst, edge_type, confidence, resolution_method, line): what each call may reach.

    * without a receiver: what the name was imported as (0.95), else the only symbol of the name in the caller's file (0.85); nothing in a
      file with a star import, and nothing for an imported name that no file exports
    * on self: the method of the caller's class or its ancestors (0.9)
    * on self.attr: the method of each type that the attribute was given (one: 0.85; several: as ambiguous); of an interface, of each
      class that names it as a base (as ambiguous)
    * on anything else: a symbol of the module that the receiver was imported from (0.95)
    """
    d = checkpoint(definitions.groupBy("fqn").agg(F.min_by(F.struct("file", "name", "kind", "class_name", "pos"), "pos").alias("_d")).select("fqn", "_d.*"))
    names = checkpoint(name_in(imports))
    inside = F.regexp_extract("src", r"(?s)::(.*)", 1)
    owner = F.when(F.contains(inside, F.lit(".")), F.substring_index(inside, ".", 1))
    attr = F.regexp_extract("receiver", r"(?s)^(?:self|this)\.(.+)", 1)
    form = F.when(F.col("receiver").isNull(), "bare").when(F.col("receiver").isin("self", "this"), "self").when(attr != "", "attr").otherwise("module")
    rows = checkpoint(calls.withColumns({"form": form, "class_name": owner, "attr_name": attr}))

    # without a receiver
    starred = names.filter("is_star").select("file").union(imports.filter("is_star").select("file")).distinct()
    bare = rows.filter("form = 'bare'").join(starred, "file", "left_anti").join(names.filter("not is_star").withColumnRenamed("local_name", "method"), ["file", "method"], "left")
    named = bare.withColumn("name", F.coalesce(F.nullif("orig_name", F.lit("")), "method"))
    module = rows.filter("form = 'module'").join(names.filter("not is_star").withColumnRenamed("local_name", "receiver"), ["file", "receiver"]).withColumn("name", F.col("method"))
    by_import = checkpoint(named.select("call_id", "src", "line", "src_file", "name").union(module.select("call_id", "src", "line", "src_file", "name")).filter("nullif(src_file, '') is not null"))
    imported = by_import.join(exported(by_import, d), ["src_file", "name"])
    alone = d.groupBy("file", F.col("name").alias("method")).agg(F.count("*").alias("n"), F.min("fqn").alias("dst")).filter("n = 1").drop("n")
    local = bare.filter("is_star is null").join(alone, ["file", "method"])

    # on self, on what attributes of self are
    faces = d.filter("kind = 'interface'").select(F.col("name").alias("resolved")).distinct().withColumn("face", F.lit(True))
    given = type_names(attributes.select("file", "class_name", "attr_name", "assigned_type").distinct(), "assigned_type", names)
    types = given.join(given.groupBy("file", "class_name", "attr_name").agg(F.count("*").alias("n_types")), ["file", "class_name", "attr_name"]).join(faces, "resolved", "left")
    classes = bases.select("file", F.col("class_name").alias("impl"), F.col("base").alias("resolved")).distinct()
    behind = classes.join(classes.groupBy("resolved").agg(F.count("*").alias("n_impl")), "resolved")
    typed = rows.filter("form = 'attr' and class_name is not null").join(types, ["file", "class_name", "attr_name"])
    own = lambda df, name, n, kind: df.select("call_id", "src", "line", "method", F.col(name).alias("class_name"), F.col(n).alias("n"), F.lit(kind).alias("kind"))
    asked = own(typed.filter("face is null"), "resolved", "n_types", "type")
    asked = checkpoint(asked.union(rows.filter("form = 'self' and class_name is not null").select("call_id", "src", "line", "method", "class_name", F.lit(1).cast("long"), F.lit("self"))))
    # an interface's classes share most of what they inherit: each method's different targets are found first, calls meet only these
    faced = checkpoint(typed.filter("face").select("call_id", "src", "line", "method", "resolved"))
    faced_methods = faced.select("resolved", "method").distinct().join(behind, "resolved").select("resolved", "method", F.col("impl").alias("class_name"), F.col("n_impl").alias("n"))
    faced_methods = checkpoint(faced_methods)
    found = checkpoint(methods_of(asked.select("class_name", "method").union(faced_methods.select("class_name", "method")), d, bases))
    targets = small(faced_methods.join(found, ["class_name", "method"]).select("resolved", "method", "n", "dst").distinct())
    by_face = faced.repartition("src").join(targets, ["resolved", "method"])  # rows of one source in one place, so that they are reduced before a shuffle
    reached = asked.join(found, ["class_name", "method"])
    sure = F.when(F.col("kind") == "self", 0.9).when((F.col("kind") == "type") & (F.col("n") == 1), 0.85).otherwise(ambiguous(F.col("n")))
    how = F.when(F.col("kind") == "self", "mro_resolved").when((F.col("kind") == "type") & (F.col("n") == 1), "constructor_type_trace").otherwise("name_heuristic_ambiguous")
    faces_edges = _edges(by_face, ambiguous(F.col("n")), F.lit("name_heuristic_ambiguous"))
    return _edges(imported, F.lit(0.95), F.lit("import_path_match")).union(_edges(local, F.lit(0.85), F.lit("same_file_scope"))).union(_edges(reached, sure, how)).union(faces_edges)


def type_edges(definitions: DataFrame, imports: DataFrame, attributes: DataFrame, bases: DataFrame) -> DataFrame:
    """Edges of classes to their bases (extends) and of methods to what they construct (instantiates), at 1.0, where one class has the name."""
    d = definitions.groupBy("fqn").agg(F.min_by(F.struct("name", "kind", "class_name"), "pos").alias("_d")).select("fqn", "_d.*")
    only = d.filter("kind in ('class', 'interface') and class_name is null").groupBy(F.col("name").alias("resolved")).agg(F.count("*").alias("n"), F.min("fqn").alias("dst")).filter("n = 1").drop("n")
    names = name_in(imports)
    rows = lambda df: df.withColumns({"call_id": F.lit(None).cast("long"), "line": F.lit(None).cast("int")})
    own = bases.select("file", "class_name", "base").distinct().withColumn("src", F.concat("file", F.lit("::"), "class_name"))
    made = attributes.filter("is_construction").withColumn("src", F.concat("file", F.lit("::"), "class_name", F.lit("."), F.coalesce(F.nullif("method_name", F.lit("")), F.lit("__init__"))))
    extends = rows(type_names(own, "base", names).join(only, "resolved"))
    builds = rows(type_names(made.select("file", "src", "assigned_type").distinct(), "assigned_type", names).join(only, "resolved"))
    return _edges(extends, F.lit(1.0), F.lit("inheritance"), "extends").union(_edges(builds, F.lit(1.0), F.lit("constructor_type_trace"), "instantiates"))


def symbol_edges(calls: DataFrame, definitions: DataFrame, imports: DataFrame, attributes: DataFrame, bases: DataFrame) -> DataFrame:
    """(src, dst, edge_type, confidence, resolution_method, line): all edges; of equal ones that are both sure (0.7 and more) or both not, the first call's."""
    every = call_edges(calls, definitions, imports, attributes, bases).union(type_edges(definitions, imports, attributes, bases))
    sure = (F.col("confidence") >= 0.7).alias("_sure")
    # within one call, of several ways to a target the surer one
    order = F.struct("call_id", -F.col("confidence"), "resolution_method")
    kept = every.groupBy("src", "dst", "edge_type", sure).agg(F.min_by(F.struct("confidence", "resolution_method", "line"), order).alias("_e"))
    return kept.select("src", "dst", "edge_type", "_e.*")
