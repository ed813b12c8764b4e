"""Column functions over text: tokens, identifiers, chunk sizes, names and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that do not count for query coverage.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if",
    "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that",
    "the", "to", "was", "will", "with", "how", "what", "where", "which", "who", "why",
]


def tokens(text: Column) -> Column:
    """ASCII word tokens of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([A-Za-z0-9_]+)"), F.lit(1))


def split_identifier(token: Column) -> Column:
    """The lower-cased token, then its parts of over one letter: between underscores, else each from a capital to the next; a single letter is kept as it is."""
    low = F.lower(token)
    words = F.regexp_extract_all(low, F.lit("([^_]+)"), F.lit(1))
    humps = F.transform(F.regexp_extract_all(token, F.lit(r"(^[^\p{Lu}]+|\p{Lu}[^\p{Lu}]*)"), F.lit(1)), F.lower)
    several = lambda parts: F.concat(F.array(low), F.filter(parts, lambda p: F.char_length(p) > 1))
    long = F.when(F.contains(token, F.lit("_")), several(words)).otherwise(F.array_distinct(several(humps)))
    return F.when(F.char_length(token) > 1, long).otherwise(F.filter(F.array(token), lambda t: F.char_length(t) > 0))


def query_terms(text: Column) -> Column:
    """Distinct terms of a query in order: words of over one letter, lower-cased before they are split, with their parts."""
    words = F.filter(tokens(text), lambda w: F.char_length(w) > 1)
    return F.array_distinct(F.flatten(F.transform(words, split_identifier)))


def normalize(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("int")


# Characters of a chunk, by category of its file, else by language, else the last.
CATEGORY_SIZES = {"docs": 1800, "config": 1200, "test": 1400}
LANGUAGE_SIZES = {1500: ["python", "typescript", "javascript", "ruby", "elixir", "julia"], 1400: ["haskell", "ocaml", "erlang"]}
OTHER_SIZE = 1300


def chunk_size(category: Column, language: Column) -> Column:
    """Target characters of a chunk."""
    look = lambda sizes, key: F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv))[key]
    return F.coalesce(look(CATEGORY_SIZES, category), look({name: n for n, names in LANGUAGE_SIZES.items() for name in names}, language), F.lit(OTHER_SIZE))


def flat_chunks(df: DataFrame, text: str, size: Column) -> DataFrame:
    """One row for each window of `size` characters, overlapping by an eighth (120 at least): chunk_index, content."""
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n")
    step = size - F.greatest(F.lit(120), F.floor(size / 8))
    n = F.when(F.char_length(clean) <= size, F.lit(1)).otherwise(F.ceil((F.char_length(clean) - size) / step) + 1).cast("int")
    cut = df.withColumns({"_clean": clean, "_size": size.cast("int"), "_step": step.cast("int")})
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return cut.withColumn("content", F.col("_clean").substr(F.col("chunk_index") * F.col("_step") + 1, F.col("_size"))).drop("_clean", "_size", "_step")


def content_hash(text: Column) -> Column:
    """MD5 of the first 4,096 characters."""
    return F.md5(F.substring(text, 1, 4096))


def slugify(text: Column) -> Column:
    """Word characters, lower case, runs of hyphens and blanks as one hyphen."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w\s-]", ""), r"[-\s]+", "-"), F.lit("-"))


def symbol_file(fqn: Column) -> Column:
    """The file of a symbol name: what stands before the first '::'."""
    return F.substring_index(fqn, "::", 1)


def keyword_count(text: Column, word: str) -> Column:
    """Occurrences of a word that letters or digits do not touch."""
    return F.regexp_count(text, F.lit(rf"(?<![A-Za-z0-9_])\Q{word}\E(?![A-Za-z0-9_])"))


def dcb(text: Column) -> Column:
    """A DCB clause as struct(raw, lrecl, blksize, recfm)."""
    part = lambda k: F.nullif(F.regexp_extract(F.upper(text), rf"{k}\s*=\s*([A-Z0-9]+)", 1), F.lit(""))
    return F.struct(text.alias("raw"), part("LRECL").alias("lrecl"), part("BLKSIZE").alias("blksize"), part("RECFM").alias("recfm"))


def source_span(text: Column) -> Column:
    """struct(source_artifact, line_start, line_end) from a reference such as 'ORDPROG.CBL L19-22'."""
    artifact = F.nullif(F.upper(F.regexp_extract(text, r"(?i)([A-Z0-9_-]+\.(?:CBL|JCL|CPY))", 1)), F.lit(""))
    start = F.nullif(F.regexp_extract(text, r"L(\d+)(?:-L?(\d+))?", 1), F.lit("")).cast("int")
    end = F.nullif(F.regexp_extract(text, r"L(\d+)(?:-L?(\d+))?", 2), F.lit("")).cast("int")
    return F.when(start.isNotNull() | artifact.isNotNull(), F.struct(artifact.alias("source_artifact"), start.alias("line_start"), F.coalesce(end, start).alias("line_end")))


def call_sites(text: Column) -> Column:
    """Line numbers of a call-site list: of each item's first token."""
    first = F.transform(F.split(text, ","), lambda x: F.element_at(F.split(F.trim(x), r"\s+"), 1))
    return F.filter(F.transform(first, lambda x: F.nullif(F.regexp_extract(x, r"L?0*(\d+)", 1), F.lit("")).cast("int")), lambda x: x.isNotNull())


def dd_mode(dd_name: Column, disp: Column) -> Column:
    """struct(mode, definitive) of a DD statement from its disposition and name."""
    name, first = F.upper(dd_name), F.upper(F.regexp_extract(disp, r"^\(?\s*([A-Za-z]+)", 1))
    made = lambda mode, sure: F.struct(F.lit(mode).alias("mode"), F.lit(sure).alias("definitive"))
    return (
        F.when(first.isin("NEW", "MOD"), made("write", True))
        .when((name == "SORTOUT") | name.startswith("OUT"), made("write", True))
        .when((name == "SORTIN") | name.startswith("IN") | (name == "STEPLIB"), made("read", True))
        .when(first.isin("SHR", "OLD"), made("read", False))
    )


def impact_score(hop: Column, central_rank: Column, in_seed_community: Column, in_neighbour: Column, in_chain: Column, bm25: Column) -> Column:
    """Impact of a file: hop weight, BM25 share, call-chain, community and centrality bonuses."""
    weight = F.when(hop.isNull(), 0.0).when(hop == 0, 3.0).when(hop == 1, 2.0).when(hop == 2, 1.2).when(hop == 3, 0.6).when(hop == 4, 0.3).otherwise(0.2)
    near = F.when(in_seed_community, 1.0).when(in_neighbour, 0.4).otherwise(0.0)
    return weight + 0.3 * bm25 + F.when(in_chain, 2.5).otherwise(0.0) + near + F.coalesce(2.0 * F.pow(F.lit(0.94), central_rank), F.lit(0.0))


# What became of an edge's target; the first rule decides all of whose conditions hold.  A condition names a part of the
# edge (method: how it was resolved; path: how its target begins; stem: how the target's own name begins; name: that name; sign:
# what the target contains) and what that part may be.
RESOLUTION_RULES = [
    ("predefined_utility", {"method": ["external_utility"]}),
    ("unresolved_symbolic", {"method": ["symbolic_program", "symbolic_dsn", "jcl_back_reference"]}),
    ("system_copybook", {"method": ["system_copybook"]}),
    ("system_copybook", {"path": ["__external__/copybook/"]}),
    ("system_copybook", {"stem": "system"}),
    ("external_runtime", {"name": "runtimes"}),
    ("external_runtime", {"stem": ["MQ", "DFH"]}),
    ("external_runtime", {"method": ["external_runtime"]}),
    ("external_runtime", {"method": "missing", "stem": ["CEE", "CBL", "DFH", "MQ"]}),
    ("not_in_snapshot", {"method": "missing"}),
    ("unresolved_symbolic", {"path": ["__unresolved__/"], "sign": ["&", "%26"]}),
    ("not_in_snapshot", {"path": ["__unresolved__/"]}),
    ("external_runtime", {"path": ["__external__/"]}),
]
MISSING_METHODS = ["program_not_in_snapshot", "copybook_not_found", "proc_not_in_snapshot", "ambiguous_program_id", "ambiguous_copybook", "ambiguous_proc"]


def resolution_class(dst: Column, method: Column, system_prefixes: list[str], runtimes: list[str]) -> Column:
    """What became of an edge's target, by RESOLUTION_RULES; what no rule fits is resolved."""
    stem = F.upper(F.regexp_replace(F.element_at(F.split(dst, "/"), -1), r"\.[^.]*$", ""))
    lists = {"system": system_prefixes, "runtimes": runtimes, "missing": MISSING_METHODS}
    begins = lambda of: lambda values: F.rlike(of, F.lit(r"^(\Q" + r"\E|\Q".join(values) + r"\E)"))
    holds = {"method": lambda v: method.isin(v), "name": lambda v: stem.isin(v), "stem": begins(stem), "path": begins(dst), "sign": lambda v: F.exists(F.array(*map(F.lit, v)), lambda x: F.contains(dst, x))}
    out = F.lit("resolved")
    for name, conditions in reversed(RESOLUTION_RULES):
        fits = F.lit(True)
        for part, values in conditions.items():
            fits = fits & holds[part](lists[values] if isinstance(values, str) else values)
        out = F.when(fits, name).otherwise(out)
    return out
