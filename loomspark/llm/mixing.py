"""Operator 8, mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source.  A node's budget is split among its children by their weights; a child
that has fewer tokens (times the epochs allowed) than its share takes all it has, and the shortage goes to
its siblings by weight before anything goes up, as a node's own capacity is the sum of its leaves'.
Budgets are whole tokens: shares are rounded down, so that less than a token a node stays unspent.  A leaf's
budget is filled with whole epochs, then with the token-prefix of one more epoch in that epoch's seeded order;
the last document counts in part.

The tree never leaves Spark.  Each level is split by one pass over its nodes: children with the same ratio of
capacity to weight fill up at the same level, so that a node orders only distinct ratios (of n tokens there are at
most sqrt(2 n) for children of one weight), not children.  A leaf's prefix is found by summing tokens over the
first, then the second byte of the order's hash; only what shares both with the border is ordered, exact repeats
as one row with a count, so a document that is a third of all rows is one row there.

Defined results: null and empty texts have 0 tokens and are taken when their place in the order is inside
the prefix; nulls in lang or source are a name of their own ('none'); repeated rows are rows of their own; an
empty table gives an empty result.  A document without a count in the token column has 0 tokens, a negative count is 0.
Docs' columns are all kept as they are; where one has the name of a column that the result adds (domain, tokens, epoch,
take_tokens), the added one is called mix_ and that name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.llm import common

DOMAIN_WEIGHTS = {"web": 0.5, "books": 0.3, "reference": 0.2}
LANGUAGE_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
#: The budget as a share of all tokens, and how often a document may be taken.
BUDGET_SHARE, EPOCHS, SEED = 0.8, 3, 17
#: Leaves up to this count are broadcast with their budgets (a few MB).
BROADCAST_LEAVES = 100_000
#: Shares this close to a whole token count as that token.
CLOSE = 1e-6
_MADE = ("domain", "tokens", "epoch", "take_tokens")


def tokens_of(text: Column) -> Column:
    """Tokens of a text for budgets: one for four bytes, rounded up."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source where no table says: by a stable hash of its name."""
    return F.element_at(F.array(*map(F.lit, DOMAIN_WEIGHTS)), (F.crc32(F.coalesce(source, F.lit("none")).cast("binary")) % len(DOMAIN_WEIGHTS) + 1).cast("int"))


def order_key(seed: int, epoch: Column, doc_id: Column, text: Column) -> Column:
    """A document's place in an epoch's order."""
    return F.xxhash64(F.lit(seed), epoch.cast("int"), doc_id, text)


def _weight(name: Column, weights: Mapping[str, float]) -> Column:
    """The weight of a name, 1 where none is given."""
    out = F.lit(1.0)
    for key, w in weights.items():
        if w <= 0:
            raise ValueError(f"weights must be positive: {key}")
        out = F.when(name == key, float(w)).otherwise(out)
    return out


def split(children: DataFrame, parents: list[str]) -> DataFrame:
    """children (parents, name, capacity, weight, own: the parent's budget) with `given`, each child's budget.

    Children are full as long as their ratio of capacity to weight is below the level that what is left gives to the
    rest; the first ratio above it fixes the level of all others.
    """
    ratio = F.col("capacity") / F.col("weight")
    by_ratio = children.groupBy(*parents, ratio.alias("ratio")).agg(F.sum("capacity").alias("c"), F.sum("weight").alias("w"), F.first("own").alias("own"))
    whole = W.partitionBy(*parents)
    before = whole.orderBy("ratio").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("own") - F.coalesce(F.sum("c").over(before), F.lit(0))
    rest = F.sum("w").over(whole.orderBy(F.desc("ratio")).rowsBetween(W.unboundedPreceding, W.currentRow))
    levels = by_ratio.withColumn("level", left / rest).filter("ratio > level").groupBy(*parents).agg(F.min_by("level", "ratio").alias("level"))
    joined = children.join(levels, parents, "left")
    given = F.when(F.col("level").isNull() | (F.col("capacity") / F.col("weight") <= F.col("level")), F.col("capacity")).otherwise(F.floor(F.col("weight") * F.col("level") + CLOSE))
    return joined.withColumn("given", F.least("capacity", F.greatest(F.lit(0), given)).cast("long")).drop("level")


def allocate(leaves: DataFrame, budget: int, weights: list[Mapping[str, float]], epochs: int = EPOCHS) -> DataFrame:
    """leaves (domain, lang, source, t: its tokens; root, if it is there, is 0) with `given`, each leaf's budget."""
    names = ["domain", "lang", "source"]
    nodes = leaves.withColumn("capacity", epochs * F.col("t"))
    nodes = nodes if "root" in leaves.columns else nodes.withColumn("root", F.lit(0))
    own = None
    for k, name in enumerate(names):
        above, here = ["root", *names[:k]], ["root", *names[: k + 1]]
        children = nodes.groupBy(*here).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(F.col(name), weights[k]))
        children = children.withColumn("own", F.lit(budget).cast("long")) if own is None else children.join(own, above)
        own = split(children, above).select(*here, F.col("given").alias("own"))
    return leaves.drop("root").join(own.drop("root").withColumnRenamed("own", "given"), names)


def _prefix(columns: list[str]) -> str:
    """A beginning of names that none of the columns has."""
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def added_names(columns: list[str]) -> list[str]:
    """The names of the columns that a mixture adds to a table with these."""
    taken, out = {c.lower() for c in columns}, []
    for name in _MADE:
        while name in taken:
            name = "mix_" + name
        out.append(name)
    return out


def mix(
    docs: DataFrame, budget_share: float = BUDGET_SHARE, epochs: int = EPOCHS, seed: int = SEED, domain_weights: Mapping[str, float] | None = None,
    language_weights: Mapping[str, float] | None = None, source_weights: Mapping[str, float] | None = None, tokens: Column | None = None, domain: Column | None = None,
) -> DataFrame:
    """Docs' columns with domain, tokens, epoch and take_tokens, a row for each time a document is taken.

    tokens and domain are expressions over docs for its exact token counts (else four bytes are a token) and its domains (else by its source).
    """
    kept = docs.columns
    size = tokens_of(F.col("text")) if tokens is None else F.greatest(F.lit(0), F.coalesce(tokens.cast("long"), F.lit(0)))
    group = domain_of(F.col("source")) if domain is None else F.coalesce(domain.cast("string"), F.lit("none"))
    d_name, t_name, e_name, take_name = added_names(kept)
    p = _prefix(docs.columns)
    leaf = [p + "d", p + "l", p + "s"]
    none = F.lit("none")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], group.alias(leaf[0]), F.coalesce("lang", none).alias(leaf[1]), F.coalesce("source", none).alias(leaf[2]), size.alias(p + "t"))

    plain = rows.groupBy(*leaf).agg(F.sum(p + "t").alias("t")).toDF("domain", "lang", "source", "t")
    leaves = common.checkpoint(plain.withColumn("root", F.lit(0)))  # stored, so that joins on it are not folded away
    sums = leaves.agg(F.sum("t").alias("t"), F.count("*").alias("n")).first()
    budget = int((sums["t"] or 0) * budget_share)
    given = allocate(leaves, budget, [domain_weights or DOMAIN_WEIGHTS, language_weights or LANGUAGE_WEIGHTS, source_weights or {}], epochs)
    plan = given.select(F.col("domain").alias(leaf[0]), F.col("lang").alias(leaf[1]), F.col("source").alias(leaf[2]), F.expr("case when t > 0 then given div t else 0 end").cast("int").alias(p + "whole"), F.expr("case when t > 0 then given % t else 0 end").alias(p + "rest"))
    plan = common.checkpoint(plan)
    small = F.broadcast if sums["n"] <= BROADCAST_LEAVES else (lambda x: x)
    key = order_key(seed, F.col(p + "whole"), F.col("doc_id"), F.col("text"))
    placed = rows.join(small(plan), leaf).withColumn(p + "key", key)
    placed = placed.withColumns({p + "a": F.shiftrightunsigned(p + "key", 56).cast("int"), p + "b": F.shiftrightunsigned(F.shiftleft(p + "key", 8), 56).cast("int")})

    def cut(of: DataFrame, by: str, left: Column, name: str) -> DataFrame:
        """For each leaf the last value of `by` that begins before `left` tokens, and the tokens before it."""
        own = W.partitionBy(*leaf).orderBy(by)
        at = of.groupBy(*leaf, by).agg(F.sum(p + "t").alias("sum"), F.first(left).alias("left"))
        at = at.withColumn("before", F.sum("sum").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("sum"))
        best = at.filter("before < left").groupBy(*leaf).agg(F.max_by(F.struct(by, "before"), by).alias("at"))
        return common.checkpoint(best.select(*leaf, F.col("at")[by].alias(f"{p}cut_{name}"), F.col("at.before").alias(f"{p}before_{name}")))

    part = placed.filter(F.col(p + "rest") > 0)
    inside = part.join(small(cut(part, p + "a", F.col(p + "rest"), "a")), leaf)
    near = inside.filter(F.col(p + "a") == F.col(p + "cut_a"))
    inside = inside.join(small(cut(near, p + "b", F.col(p + "rest") - F.col(p + "before_a"), "b")), leaf)

    original = [F.col(f"`{c}`") for c in kept]
    whole, t, rest = F.col(p + "whole"), F.col(p + "t"), F.col(p + "rest")
    shown = [*original, F.col(leaf[0]).alias(d_name), t.alias(t_name)]
    again = placed.filter(whole > 0).select(*shown, F.explode(F.sequence(F.lit(0), whole - 1)).alias(e_name), t.alias(take_name))
    at_a, at_b = F.col(p + "a") == F.col(p + "cut_a"), F.col(p + "b") == F.col(p + "cut_b")
    below = inside.filter((F.col(p + "a") < F.col(p + "cut_a")) | (at_a & (F.col(p + "b") < F.col(p + "cut_b")))).select(*shown, whole.alias(e_name), t.alias(take_name))
    # the border: exact repeats are one row with a count
    edge = inside.filter(at_a & at_b).select(*leaf, F.col(p + "key").alias("key"), F.sha2(F.to_json(F.struct(*original)), 256).alias("digest"), F.struct(*original).alias("row"), t.alias("t"), whole.alias("whole"), (rest - F.col(p + "before_a") - F.col(p + "before_b")).alias("left"))
    edge = edge.groupBy(*leaf, "key", "digest").agg(F.first("row").alias("row"), F.first("t").alias("t"), F.first("whole").alias("whole"), F.first("left").alias("left"), F.count("*").alias("n"))
    own = W.partitionBy(*leaf).orderBy("key", "digest").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = edge.withColumn("before", F.sum(F.col("t") * F.col("n")).over(own) - F.col("t") * F.col("n")).filter("before < left")
    copies = F.when(F.col("t") == 0, F.col("n")).otherwise(F.least("n", F.ceil((F.col("left") - F.col("before")) / F.col("t")).cast("long")))
    edge = edge.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    edge = edge.select("row.*", F.col(leaf[0]).alias(d_name), F.col("t").alias(t_name), F.col("whole").alias(e_name), F.least("t", F.col("left") - F.col("before") - F.col("i") * F.col("t")).alias(take_name))
    return again.union(below).union(edge)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "epoch", "tokens", "take_tokens")


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
