import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from cases import frame, odd_documents, words
from pyspark.sql import functions as F

from loomspark.llm import mixing


def brute_split(budget, weights, capacity):
    """Each child's whole tokens, by filling up children one round after another."""
    given, open_, left = {}, dict(capacity), Fraction(min(budget, sum(capacity.values())))
    while open_:
        total = sum(Fraction(str(weights.get(n, 1.0))) for n in open_)
        share = {n: left * Fraction(str(weights.get(n, 1.0))) / total for n in open_}
        full = [n for n in open_ if share[n] >= capacity[n]]
        if not full:
            return given | {n: int(s + Fraction(1, 10**6)) for n, s in share.items()}
        for n in full:
            given[n] = capacity[n]
            left -= open_.pop(n)
    return given


def brute_allocate(available, budget, weights, epochs):
    out = {}

    def down(prefix, own):
        if len(prefix) == len(weights):
            out[prefix] = own
            return
        capacity = Counter()
        for path, t in available.items():
            if path[: len(prefix)] == prefix:
                capacity[path[len(prefix)]] += epochs * t
        for name, part in brute_split(own, weights[len(prefix)], capacity).items():
            down((*prefix, name), part)

    down((), budget)
    return out


def allocate(spark, available, budget, weights, epochs):
    leaves = spark.createDataFrame([(*k, v) for k, v in available.items()], "domain string, lang string, source string, t long")
    return {(r.domain, r.lang, r.source): r.given for r in mixing.allocate(leaves, budget, weights, epochs).collect()}


def test_allocation_keeps_shortages_below_before_above(spark):
    available = {("web", "en", "s1"): 10, ("web", "en", "s2"): 1000, ("web", "de", "s1"): 1000, ("books", "en", "s3"): 1000}
    got = allocate(spark, available, 400, [{"web": 0.5, "books": 0.5}, {"en": 0.5, "de": 0.5}, {}], 1)
    assert got == {("web", "en", "s1"): 10, ("web", "en", "s2"): 90, ("web", "de", "s1"): 100, ("books", "en", "s3"): 200}


def test_allocation_matches_brute_force(spark):
    rng = random.Random(3)
    for _ in range(2):
        available = {(rng.choice(["web", "books", "x"]), rng.choice(["en", "de", "fr", "zz"]), f"s{rng.randrange(9)}"): rng.choice([0, 1, 5, 40, 41, 3000]) for _ in range(40)}
        weights = [mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, {"s1": 2.5, "s2": 0.1}]
        for share, epochs in ((0.05, 1), (0.6, 1), (0.99, 1), (2.5, 3), (4.0, 3)):
            budget = int(sum(available.values()) * share)
            assert allocate(spark, available, budget, weights, epochs) == brute_allocate(available, budget, weights, epochs)
    with pytest.raises(ValueError):
        allocate(spark, available, 1, [{"web": 0.0}, {}, {}], 1)


def brute_mix(keyed, share, epochs):
    """(doc_id, epoch, take_tokens) of all taken rows from rows (doc_id, text, domain, lang, source, tokens, key of an epoch)."""
    available = defaultdict(int)
    for r in keyed:
        available[r.domain, r.lang or "none", r.source or "none"] += r.tokens
    given = brute_allocate(available, int(sum(available.values()) * share), [mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, {}], epochs)
    out = []
    for leaf, total in available.items():
        whole, rest = divmod(given[leaf], total) if total else (0, 0)
        own = [r for r in keyed if (r.domain, r.lang or "none", r.source or "none") == leaf]
        out += [(r.doc_id, k, r.tokens) for k in range(whole) for r in own]
        before = 0
        for r in sorted(own, key=lambda r: r[f"key{whole}"] % 2**64):
            if before < rest:
                out.append((r.doc_id, whole, min(r.tokens, rest - before)))
            before += r.tokens
    return sorted(out, key=repr)


def keyed(docs, epochs):
    return docs.select("doc_id", "lang", "source", mixing.domain_of(F.col("source")).alias("domain"), mixing.tokens_of(F.col("text")).alias("tokens"), *[mixing.order_key(mixing.SEED, F.lit(k), F.col("doc_id"), F.col("text")).alias(f"key{k}") for k in range(epochs + 1)]).collect()


@pytest.mark.parametrize(("share", "epochs"), [(0.3, 1), (0.9, 3)])
def test_query_matches_brute_force(spark, share, epochs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(((r.doc_id, r.epoch, r.take_tokens) for r in mixing.mix(docs, share, epochs).collect()), key=repr)
    assert got == brute_mix(keyed(docs, epochs), share, epochs)


def test_repeated_rows_and_odd_rows_match_brute_force(spark):
    rng = random.Random(5)
    rows = odd_documents() + [(20, words(rng, 9), "en", "hot", 1, "x", 3, "y")] * 400 + [(21, "", "en", "hot", 0, "x", 3, "y")] * 5
    docs = frame(spark, rows).repartition(3)
    for share, epochs in ((0.1, 1), (0.37, 1), (0.83, 2), (1.0, 1)):
        made = mixing.mix(docs, share, epochs)
        got = sorted(((r.doc_id, r.epoch, r.take_tokens) for r in made.collect()), key=repr)
        want = brute_mix(keyed(docs, epochs), share, epochs)
        # of rows with one key, those that are cut are interchangeable
        assert got == want


def test_columns_of_any_name(spark):
    """Docs' columns stay as they are; an added column whose name is taken gets another."""
    clash = ["doc_id", "text", "lang", "source", "whole", "rest", "_a", "_b", "_key", "_mix_t", "before", "row", "left", "n", "Domain", "tokens", "leaf_lang", "a.b", "mix_tokens"]
    docs = spark.createDataFrame([(i, f"text {i} of some length", "en", "a", *range(15)) for i in range(50)], ", ".join(f"`{c}` {t}" for c, t in zip(clash, ["long", "string", "string", "string"] + ["int"] * 15, strict=True)))
    made = mixing.mix(docs, 0.5, 2)
    assert made.columns == [*clash, "mix_domain", "mix_mix_tokens", "epoch", "take_tokens"]
    assert {tuple(r)[4:19] for r in made.collect()} == {tuple(range(15))}


def test_exact_token_counts_and_domains(spark):
    """A table's own counts decide budgets and prefixes, and are returned unchanged."""
    rng = random.Random(8)
    rows = [(i, f"text {i % 90}", "en", f"s{i % 5}", rng.choice([0, 1, 7, 1000, None, -3]), f"d{i % 2}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens long, domain string")
    weights = {"d0": 0.9, "d1": 0.1}
    made = mixing.mix(docs, 0.4, 1, domain_weights=weights, tokens=F.col("tokens"), domain=F.col("domain"))
    assert made.columns == [*docs.columns, "mix_domain", "mix_tokens", "epoch", "take_tokens"]
    got = made.collect()
    counts = {r[0]: max(0, r[4] or 0) for r in rows}
    assert all(r.tokens == rows[r.doc_id][4] and r.mix_tokens == counts[r.doc_id] and r.mix_domain == r.domain for r in got)
    available = defaultdict(int)
    for i, _, _, source, _, d in rows:
        available[d, "en", source] += counts[i]
    given = brute_allocate(available, int(sum(counts.values()) * 0.4), [weights, mixing.LANGUAGE_WEIGHTS, {}], 1)
    taken = Counter()
    for r in got:
        taken[r.domain, "en", r.source] += r.take_tokens
    assert {k: v for k, v in given.items() if v} == {k: v for k, v in taken.items() if v}


def test_empty_table(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
