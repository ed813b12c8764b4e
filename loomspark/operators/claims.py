"""What design documents claim: tables of Markdown lines, claims of table rows by kind, and citations.

Rows of tables are (cluster_id, doc_id, doc_kind, artifact, section_id, section_title, line, headers, cells): doc_kind is dd_cobol,
dd_jcl or bd, headers and cells are arrays of one length.  A cluster holds the documents that are read together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions.text import slugify
from loomspark.operators.relations import artifact_name
from loomspark.sources.tables import checkpoint

# Utilities of the system, which are never programs of the code.
UTILITIES = ["IDCAMS", "SORT", "IEFBR14", "CEE3ABD", "DFSORT", "ICEGENER", "IEBGENER"]
# The headers under which a cell may stand, in the order in which they count.
HEADERS = {
    "called": ["Called program", "Called Program", "Called Subroutine", "Program"],
    "sites": ["Call sites (line refs)", "Call sites", "Call-sites", "Sites"],
    "resolved": ["Resolved?", "Resolution", "Resolution Status", "Status"],
    "member": ["COPY member", "Member"],
    "source": ["Source line"],
    "field": ["Field", "Field Name", "Name"],
    "pic": ["PIC", "Picture", "Format"],
    "notes": ["Notes", "Description"],
    "step": ["Step", "STEP"],
    "program": ["Program/Proc", "Program", "PROGRAM"],
    "parameters": ["Key Parameters", "Parameters"],
    "ddname": ["DDName", "DDNAME"],
    "disp": ["Disposition", "DISP"],
    "dcb": ["DCB"],
    "dsn": ["DSN", "Dataset / Resource", "Dataset", "Resource"],
    "input": ["Input", "Inputs", "Input Dataset"],
    "output": ["Output", "Outputs", "Output Dataset"],
    "process": ["Process", "Action", "Processing Stage", "Description"],
    "stage": ["Stage"],
    "evidence": ["Evidence", "Ref"],
    "actor": ["Actor", "actor"],
    "role": ["Role in this cluster", "Role"],
    "dependency": ["Dependency"],
    "resolution": ["Resolution"],
}
# How names, steps, datasets and citations look.
DSN = r"\b[A-Z][A-Z0-9]*(?:\.[A-Z0-9#$@-]{1,8})+\b"
STEP_TITLE = r"\b(STEP\d+|DELDEF\d+|[A-Z][A-Z0-9_-]{2,})\b"
STEP_NAME = r"(?i)\b(STEP\d+|DELDEF\d+|[A-Z0-9_-]+@L\d+)\b"
ARROW = r"^([A-Za-z0-9._/]+)\s*(?:-->|->|→|—>)\s*([A-Za-z0-9._,\s/()]+)"
REPORT = r"GEN\.DD\.(?:COBOL|JCL)-[A-Z0-9_-]+\.report\.md"
# Words that make an input a dataset that is written.
WRITES = ["delete", "remove", "cleanup", "disp=(mod,delete", "disp=(new"]

_CLAIM = "struct<predicate:string,subject:string,object:string,value:string,qualifiers:map<string,string>,status:string>"


def table_rows(lines: DataFrame) -> DataFrame:
    """Lines of Markdown (doc_id, line, text) to rows of its tables: (doc_id, section_id, section_title, line, headers, cells).

    The last heading above a table is its section; section_id is the heading's number, or its slug.  A table is a run of lines between bars; its first line has
    the headers, the second (dashes and colons) is skipped.  Cells that a row lacks are empty, those beyond the headers are dropped.
    """
    own = W.partitionBy("doc_id").orderBy("line")
    so_far = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    bars = F.rlike("text", F.lit(r"^\s*\|.+\|\s*$"))
    head = F.regexp_extract("text", r"^#{1,4}\s+(.+?)\s*$", 1)
    marked = lines.select("doc_id", "line", "text", F.coalesce(bars, F.lit(False)).alias("_bar"), F.nullif(head, F.lit("")).alias("_head"))
    marked = marked.withColumn("_title", F.last("_head", ignorenulls=True).over(so_far)).withColumn("_start", F.col("_bar") & ~F.coalesce(F.lag("_bar").over(own), F.lit(False)))
    inner = F.regexp_replace(F.trim("text"), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    placed = marked.withColumn("_cells", F.when(F.col("_bar"), cells)).withColumn("headers", F.last(F.when(F.col("_start"), F.col("_cells")), ignorenulls=True).over(so_far))
    placed = placed.withColumn("_ruler", F.coalesce(F.lag("_start").over(own), F.lit(False)))
    body = placed.filter("_bar and not _start and not _ruler")
    number = F.nullif(F.regexp_extract("_title", r"^(\d+(?:\.\d+)*)\.?\s", 1), F.lit(""))
    width = F.size("headers")
    even = F.slice(F.concat("_cells", F.array_repeat(F.lit(""), width)), F.lit(1), width)
    return body.select("doc_id", F.coalesce(number, slugify(F.col("_title"))).alias("section_id"), F.col("_title").alias("section_title"), "line", "headers", even.alias("cells"))


def cell(what: str) -> Column:
    """A row's cell under the first of the headers that holds something, else the empty string."""
    found = [F.nullif(F.trim(F.get("cells", F.array_position("headers", F.lit(h)) - 1)), F.lit("")) for h in HEADERS[what]]
    return F.coalesce(*found, F.lit(""))


def kind_of() -> Column:
    """The kind of claim that a table makes, by its document's kind and parts of its headers; the first that fits."""
    has = lambda *parts: F.exists("headers", lambda h: F.rlike(F.upper(h), F.lit("|".join(parts))))
    cobol, jcl, basic = (F.col("doc_kind") == k for k in ("dd_cobol", "dd_jcl", "bd"))
    return (
        F.when(cobol & has("CALLED PROGRAM"), "called").when(cobol & has("COPY MEMBER"), "copied").when(cobol & has("FIELD") & has("PIC"), "field")
        .when(jcl & has("STEP") & has("PROGRAM") & ~has("DDNAME"), "step").when(jcl & has("DDNAME") & has("DSN", "DATASET", "RESOURCE"), "dd")
        .when(basic & has("STAGE", "PROCESS", "INPUT", "OUTPUT"), "flow").when(basic & has("ACTOR"), "actor").when(basic & has("DEPENDENC"), "dependency")
    )


def _first(x: Column, pattern: str) -> Column:
    """What a pattern finds first, null if nothing."""
    return F.nullif(F.regexp_extract(x, pattern, 0), F.lit(""))


def _head(x: Column, ends: str) -> Column:
    return F.upper(F.trim(F.element_at(F.split(x, ends), 1)))


def _typed(name: Column) -> Column:
    return F.concat(F.when(name.isin(UTILITIES), "extroutine/").otherwise("program/"), name)


def _qualifiers(**kv: Column) -> Column:
    """A map without the keys whose value is null."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, kv)), F.array(*kv.values())), lambda _, v: v.isNotNull())


def _claim(predicate: str, subject: Column, object_: Column | None = None, value: Column | None = None, qualifiers: Column | None = None, status: Column | str = "asserted") -> Column:
    text = F.lit(None).cast("string")
    made = {"predicate": F.lit(predicate), "subject": subject, "object": text if object_ is None else object_, "value": text if value is None else value}
    made |= {"qualifiers": F.create_map().cast("map<string,string>") if qualifiers is None else qualifiers, "status": F.lit(status) if isinstance(status, str) else status}
    return F.struct(*(v.alias(k) for k, v in made.items())).cast(_CLAIM)


def _some(*claims: Column) -> Column:
    return F.array_compact(F.array(*claims))


# The cells that claims of a kind read.
CELLS = {
    "called": ["called", "sites", "resolved"],
    "copied": ["member", "source"],
    "field": ["field", "pic", "notes"],
    "step": ["step", "program", "parameters"],
    "dd": ["ddname", "disp", "dcb", "dsn"],
    "flow": ["input", "output", "process", "stage"],
    "actor": ["actor", "role"],
    "dependency": ["dependency", "resolution"],
}


def _parsed(tables: DataFrame) -> DataFrame:
    """Each row's kind (`_kind`), the cells that its kind reads (`_c_...`, null for other kinds), and the names by which a detailed design is known.

    Stored, as parsing costs more than all that follows and every kind of claim reads it.
    """
    kinds = tables.withColumn("_kind", kind_of())
    needed = {what: [k for k, own in CELLS.items() if what in own] for own in CELLS.values() for what in own}
    cells = [F.when(F.col("_kind").isin(kinds_), cell(what)).alias(f"_c_{what}") for what, kinds_ in needed.items()]
    return checkpoint(kinds.select("cluster_id", "doc_id", "doc_kind", artifact_name(F.col("artifact")).alias("_own"), "section_id", "section_title", "line", "_kind", *cells, _known().alias("_known")))


def _c() -> dict[str, Column]:
    return {what: F.col(f"_c_{what}") for own in CELLS.values() for what in own}


def _found(rows: DataFrame, job: str, programs: str) -> DataFrame:
    """Parsed rows with what patterns find in them, each once: names of fields, steps and datasets that claims name repeatedly."""
    c = _c()
    of = lambda kind, x: F.when(F.col("_kind") == kind, x)
    place = F.coalesce(_first(F.upper("section_title"), STEP_TITLE), F.upper(F.element_at(F.split("section_id", "/"), -1)))
    stage = _first(F.concat_ws(" ", c["process"], c["stage"], "section_id"), STEP_NAME)
    doer = F.upper(_first(c["process"], rf"(?i)\b({programs}|{'|'.join(UTILITIES)})\b"))
    return rows.withColumns({
        "_sites": of("called", F.transform(F.filter(F.split(c["sites"], ","), lambda s: F.trim(s) != ""), lambda s: F.trim(F.regexp_replace(s, r"\s*\(.*?\)", "")))),
        "_name": of("field", F.trim(F.regexp_replace(F.upper(c["field"]), r"\s*\(L?\d+[-–]?\d*\)$", ""))),
        "_runs": of("step", _head(c["program"], r"[\s,]")),
        "_step": of("step", _head(c["step"], r"[\s(@]")),
        "_guard": of("step", F.upper(_first(c["parameters"], r"(?i)\bCOND=\([^)]+\)"))),
        "_place": of("dd", place),
        "_dcb": of("dd", F.nullif(F.trim(F.regexp_replace(c["dcb"], r"\s*\([^)]*\)", "")), F.lit(""))),
        "_data": of("dd", F.upper(_first(c["dsn"], DSN))),
        "_subject": of("flow", F.coalesce(F.concat(F.lit(f"step/{job}."), _head(stage, r"[\s(@]")), _typed(doer))),
    })


def _row_claims(narrow: tuple[str, str, str, str] | None) -> Column:
    """All claims of a row (of _found) of the kinds that need nothing but the row."""
    c, own = _c(), F.col("_own")
    program, job_node = F.concat(F.lit("program/"), own), F.concat(F.lit("job/"), own)
    concat = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))

    called, shown = F.upper(c["called"]), F.upper(c["resolved"])
    sites = F.col("_sites")
    outside = F.contains(shown, F.lit("EXTERNAL")) | called.isin(UTILITIES)
    unsure = outside | F.contains(c["resolved"], F.lit("✗")) | F.contains(shown, F.lit("UNRESOLVED"))
    calls = _claim("calls", program, concat(F.when(unsure, "extroutine/").otherwise("program/"), called), F.when(c["sites"] == "", 0).otherwise(F.size(sites)).cast("string"), _qualifiers(call_sites=F.array_join(sites, ","), resolution_status=c["resolved"]), F.when(outside, "external").when(unsure, "unresolved").otherwise("asserted"))

    member = F.replace(F.upper(c["member"]), F.lit(".CPY"), F.lit(""))
    copies = _claim("copies", program, concat("copybook/", member), c["source"])

    name, pic = F.col("_name"), F.upper(c["pic"])
    fields = [F.when((name != "") & (pic != ""), _claim("field_pic", concat("field/", own, ".", name), None, pic))]
    if narrow:
        dest, dest_pic, source, source_pic = narrow
        hit = F.contains(name, F.lit(dest)) | F.contains(name, F.lit(source)) | F.contains(F.lower(c["notes"]), F.lit("truncat"))
        widths = _qualifiers(relation=F.lit("narrower_than"), dest_pic=F.lit(dest_pic), src_pic=F.lit(source_pic))
        fields.append(F.when((name != "") & (pic != "") & hit, _claim("field_width_relation", concat("field/", own, f".{dest}"), concat("field/", own, f".{source}"), F.lit("narrower_than"), widths)))

    runs, step, guard = F.col("_runs"), concat("step/", own, ".", F.col("_step")), _qualifiers(cond_guard=F.col("_guard"))
    both = (c["step"] != "") & (c["program"] != "")
    steps = [F.when(both, _claim("runs", job_node, step, None, guard)), F.when(both, _claim("runs", step, _typed(runs), None, guard, F.when(runs.isin(UTILITIES), "external").otherwise("asserted")))]

    place = F.col("_place")
    dd_name, at = F.upper(c["ddname"]), concat("step/", own, ".", place)
    dd = concat("dd/", own, ".", place, ".", dd_name)
    dcb, data, mode = F.col("_dcb"), concat("dataset/", F.col("_data")), F.when(F.rlike(F.upper(c["disp"]), F.lit("NEW|MOD|WRITE")), "write").otherwise("read")
    there = (dd_name != "") & data.isNotNull()
    bound = [
        F.when(dd_name != "", _claim("binds_dd", at, dd, None, _qualifiers(dcb=dcb, disp=c["disp"]))),
        F.when(there, _claim("binds_dd", dd, data, None, _qualifiers(mode=mode, disp=c["disp"], dcb=dcb))),
        F.when(there, _claim("accesses", at, data, None, _qualifiers(mode=mode, ddname=dd_name, disp=c["disp"], dcb=dcb))),
    ]

    subject = F.col("_subject")
    named = lambda x: F.filter(F.regexp_extract_all(x, F.lit(f"({DSN})"), 1), lambda d: ~F.endswith(d, F.lit(".REPORT.MD")))
    taken = F.lower(F.concat_ws(" ", c["process"], c["input"]))
    wipes = F.lit(False)
    for word in WRITES:
        wipes = wipes | F.contains(taken, F.lit(word))
    moved = lambda of, how: F.transform(named(of), lambda d: _claim("accesses", subject, F.concat(F.lit("dataset/"), d), None, _qualifiers(mode=how, cell=of)))
    flow = F.when(subject.isNotNull(), F.concat(moved(c["input"], F.when(wipes, "write").otherwise("read")), moved(c["output"], F.lit("write"))))

    kind = F.col("_kind")
    return (
        F.when(kind == "called", _some(F.when(called != "", calls))).when(kind == "copied", _some(F.when(member != "", copies))).when(kind == "field", _some(*fields))
        .when(kind == "step", _some(*steps)).when(kind == "dd", _some(*bound)).when(kind == "flow", flow)
    ).cast(f"array<{_CLAIM}>")


def _known() -> Column:
    """The names (name, is) that a row of a detailed design makes known."""
    run, member = _head(cell("program"), r"[\s,]"), F.replace(F.upper(cell("member")), F.lit(".CPY"), F.lit(""))
    cobol, jcl = F.col("doc_kind") == "dd_cobol", F.col("doc_kind") == "dd_jcl"
    copies = F.exists("headers", lambda h: F.contains(F.upper(h), F.lit("COPY MEMBER")))
    known = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("is"))
    of_cobol = F.array(known(artifact_name(F.col("artifact")), "program"), F.when(copies & (member != ""), known(member, "copybook")))
    of_jcl = F.array(F.when((cell("program") != "") & ~run.isin(UTILITIES), known(run, "program")), F.when(cell("ddname") != "", known(F.upper(cell("ddname")), "ddname")))
    return F.when(cobol, F.array_compact(of_cobol)).when(jcl, F.array_compact(of_jcl))


def _by_name(found: DataFrame) -> DataFrame:
    rows = found.select("cluster_id", F.explode("_known").alias("f"))
    return rows.groupBy("cluster_id", F.col("f.name").alias("name")).agg(*(F.bool_or(F.col("f.is") == k).alias(k) for k in ("program", "copybook", "ddname")))


def known_names(tables: DataFrame) -> DataFrame:
    """(cluster_id, name, program, copybook, ddname): what the detailed designs of a cluster know a name as."""
    return _by_name(tables.select("cluster_id", _known().alias("_known")))


def table_claims(tables: DataFrame, job: str, programs: str, narrow: tuple[str, str, str, str] | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(cluster_id, doc_id, side, line, kind, predicate, subject, object, value, qualifiers, status): what each row of a table claims.

    job is the job whose steps a basic design's flow names, programs a pattern of the program names there, narrow a pair of
    fields of which the first cuts the second off (its name and picture, then the other's), aliases (alias, dsn) other names of
    datasets.  Actors and dependencies are told apart by what the detailed designs of the cluster know.
    """
    parsed = _parsed(tables)
    rows = parsed.filter("_kind is not null")
    base = ["cluster_id", "doc_id", F.when(F.col("doc_kind") == "bd", "bd").otherwise("dd").alias("side"), "line", F.col("_kind").alias("kind")]
    # an outer explode, since for the other Spark infers a filter that works out all claims once more
    plain = _found(rows.filter("_kind not in ('actor', 'dependency')"), job, programs)
    plain = plain.select(*base, F.explode_outer(_row_claims(narrow)).alias("_c")).filter("_c is not null").select("cluster_id", "doc_id", "side", "line", "kind", "_c.*")
    known = checkpoint(_by_name(parsed))

    # actors: programs that are known, else persons and systems
    actor = rows.filter("_kind = 'actor'").select(*base, F.col("_c_actor").alias("_actor"), F.col("_c_role").alias("_role"))
    actor = actor.withColumn("name", _first(F.col("_actor"), r"\b[A-Z0-9]{6,8}\b")).join(known.filter("program").select("cluster_id", "name", "program"), ["cluster_id", "name"], "left")
    person = F.replace(F.lower(F.trim(F.regexp_replace("_actor", r"[^\w\s-]", ""))), F.lit(" "), F.lit("_"))
    said = F.when(F.col("program"), _claim("references", F.concat(F.lit("program/"), "name"), qualifiers=_qualifiers(is_actor=F.lit("true"), role=F.col("_role")))).when(person != "", _claim("references", F.concat(F.lit("actor/"), person)))
    actors = actor.select("cluster_id", "doc_id", "side", "line", "kind", said.cast(_CLAIM).alias("_c")).filter("_c is not null").select("cluster_id", "doc_id", "side", "line", "kind", "_c.*")

    # dependencies: caller -> callees, each of which is a copybook, a DD name, a program, a utility or nothing
    part = lambda k: F.regexp_extract("_c_dependency", ARROW, k)
    dep = rows.filter("_kind = 'dependency'").select(*base, F.col("_c_dependency").alias("_dep"), F.col("_c_resolution").alias("_res"), part(1).alias("_from"), F.explode(F.split(part(2), "[,/]")).alias("_to"))
    dep = dep.filter("_from <> '' and not contains(_from, '.')").withColumns({"_caller": F.upper(F.substring_index("_from", "/", 1)), "name": F.upper(F.regexp_extract("_to", r"^\s*([A-Za-z0-9]+)", 1))}).filter("name <> ''")
    callers = known.filter("program").select("cluster_id", F.col("name").alias("_caller"))
    dep = dep.join(callers, ["cluster_id", "_caller"], "left_semi").join(known, ["cluster_id", "name"], "left")
    sure = F.contains("_res", F.lit("✓")) | F.contains(F.lower("_res"), F.lit("resolved"))
    caller, status = F.concat(F.lit("program/"), "_caller"), F.when(sure, "asserted").otherwise("unresolved")
    sites = F.nullif(F.regexp_extract("_dep", r"(?i)\((\d+)\s*call\s*sites?\)", 1), F.lit(""))
    goes = lambda kind: _claim("calls", caller, F.concat(F.lit(kind), "name"), sites, None, status)
    told = (
        F.when(F.col("copybook"), _claim("copies", caller, F.concat(F.lit("copybook/"), "name"), None, None, status)).when(F.col("ddname"), F.lit(None).cast(_CLAIM))
        .when(F.col("program"), goes("program/")).when(F.col("name").isin(UTILITIES), goes("extroutine/")).when(sure, goes("program/"))
    )
    deps = dep.select("cluster_id", "doc_id", "side", "line", "kind", told.cast(_CLAIM).alias("_c")).filter("_c is not null").select("cluster_id", "doc_id", "side", "line", "kind", "_c.*")

    every = plain.unionByName(actors).unionByName(deps)
    if aliases is None:
        return every
    renamed = aliases.select(F.concat(F.lit("dataset/"), F.upper("alias")).alias("object"), F.concat(F.lit("dataset/"), F.upper("dsn")).alias("_canon")).dropDuplicates(["object"])
    return every.join(renamed, "object", "left").withColumn("object", F.coalesce("_canon", "object")).drop("_canon").select(*every.columns)


def citations(lines: DataFrame) -> DataFrame:
    """(doc_id, line, style, target_doc, target) that lines (doc_id, line, text) cite: sections, steps (each of a run), numbered headings by name.

    A citation of a report as such has no target.
    """
    def found(pattern: str, *groups: int) -> Column:
        parts = [F.regexp_extract_all("text", F.lit(pattern), k) for k in groups]
        return F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("a", "b", "c"), strict=False)))

    def rows(style: str, hits: Column, target: Column) -> DataFrame:
        one = lines.select("doc_id", "line", F.explode(hits).alias("h"))
        return one.select("doc_id", "line", F.lit(style).alias("style"), F.col("h.a").alias("target_doc"), target.alias("target"))

    section = rows("section", found(rf"({REPORT})(?:\s+§(\d+(?:\.\d+)*))?", 1, 2), F.nullif(F.col("h.b"), F.lit("")))
    step = rows("step", found(rf"(?i)({REPORT})\s+step\s+([\d.]+(?:/[\d.]+)*)", 1, 2), F.col("h.b"))
    step = step.withColumn("target", F.explode(F.split("target", "/")))
    named = rows("unnumbered", found(rf"(?i)({REPORT})\s+§(\d+)\s+([A-Za-z0-9_-]+)", 1, 2, 3), F.concat_ws(" ", "h.b", "h.c"))
    return section.union(step).union(named)


def broken_citations(cites: DataFrame, documents: DataFrame, headings: DataFrame, steps: DataFrame) -> DataFrame:
    """cites (doc_id, line, style, target_doc, target) that lead nowhere, with `missing`: 'document' or 'target'.

    A section is found by its id or as the beginning of a heading's title; a run of steps needs each of its steps; a numbered
    heading with a name is found where a section id begins with the number and, behind its slash, the name's slug.  documents
    (artifact), headings (artifact, section_id, title), steps (artifact, step_id).
    """
    c = cites.withColumn("_id", F.xxhash64("doc_id", "line", "style", "target_doc", "target"))
    known = documents.select(F.col("artifact").alias("target_doc")).distinct()
    lost = c.join(known, "target_doc", "left_anti").withColumn("missing", F.lit("document"))
    rest = c.filter("target is not null").join(known, "target_doc", "left_semi")
    # a prefix index: every beginning of a title or slug that a citation could name leads to its document by equality
    tops = headings.select(F.col("artifact").alias("target_doc"), "section_id", F.coalesce("title", F.lit("")).alias("title"))
    begins = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(x))), lambda k: F.substring(x, F.lit(1), k))
    ids = tops.select("target_doc", F.col("section_id").alias("target")).union(tops.select("target_doc", F.explode(begins(F.col("title")))))
    slugs = tops.filter("section_id like '%/%'").select("target_doc", F.substring_index("section_id", "/", 1).alias("_n"), F.explode(begins(F.regexp_extract("section_id", "^[^/]*/(.*)$", 1))).alias("_slug"))
    by_section = rest.filter("style = 'section'").join(ids.distinct(), ["target_doc", "target"], "left_anti")
    named = rest.filter("style = 'unnumbered'").withColumns({"_n": F.substring_index("target", " ", 1), "_slug": slugify(F.regexp_extract("target", r"^\S+ (.*)$", 1))})
    by_name = named.join(slugs.distinct(), ["target_doc", "_n", "_slug"], "left_anti").drop("_n", "_slug")
    # relational division: as many of a run's different steps are there as it has
    parts = rest.filter("style = 'step'").withColumn("_part", F.explode(F.array_distinct(F.split("target", "/"))))
    have = steps.select(F.col("artifact").alias("target_doc"), F.col("step_id").alias("_part")).distinct().withColumn("_there", F.lit(1))
    by_step = parts.join(have, ["target_doc", "_part"], "left").groupBy("target_doc", "doc_id", "line", "style", "target", "_id").agg(F.count("*").alias("n"), F.count("_there").alias("m")).filter("m < n")
    columns = ["doc_id", "line", "style", "target_doc", "target"]
    gone = by_section.select(columns).union(by_name.select(columns)).union(by_step.select(columns)).withColumn("missing", F.lit("target"))
    return lost.select(*columns, "missing").union(gone).distinct()
