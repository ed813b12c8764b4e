"""Ranked lexical search against plain Python over all documents."""

import math
import random
import re
from collections import Counter

import pytest
from cases import SCHEMA, frame, odd_documents

from loomspark.llm import lexical as lx

ITEMS = "item_id long, text string, doc_id long, term string, score int"


def terms_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", low)


def brute(docs, items, k):
    counted = [(d, Counter(terms_of(x))) for d, x in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, x in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms_of(x))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            scored.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c), d))
        best = sorted((s, d) for s, d in ((-s, (d is None, d or 0)) for s, d in scored if s > 0))[:k]
        out += [(i, r, None if d[0] else d[1], -s) for r, (s, d) in enumerate(best, 1)]
    return sorted(out, key=repr)


def zipf_text(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))


@pytest.mark.parametrize(("owners", "shard_docs", "bundle_items", "k"), [(4, 32, 3, 5), (1, 1000, 100, 3), (3, 7, 2, 50)])
def test_ranking(spark, owners, shard_docs, bundle_items, k):
    rng = random.Random(owners)
    docs = [(i, zipf_text(rng, rng.randint(0, 60))) for i in range(300)]
    docs += [(r[0], r[1]) for r in odd_documents()] + [(500 + i, docs[3][1]) for i in range(60)] + [(3, "W1 w2 ... é中文 W1"), (None, docs[3][1])]
    items = [(i, zipf_text(rng, rng.randint(1, 25)) + rng.choice(["", " É中文", " Changed"])) for i in range(11)]
    items += [(0, "w5 w6"), (100, None), (101, ""), (102, "?!"), (None, "w1 w2"), (103, docs[3][1]), (104, "nowhere"), (105, odd_documents()[6][1])]
    df = frame(spark, [(d, x, "en", "a", 0, "t", 1, "c") for d, x in docs]).repartition(3)
    asked = spark.createDataFrame([(i, x, 1, "term", 2) for i, x in items], ITEMS)
    got = lx.ranked(df, asked, k=k, owners=owners, shard_docs=shard_docs, bundle_items=bundle_items)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == ["item_id bigint", "rank int", "doc_id bigint", "score bigint"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = frame(spark, odd_documents()), spark.createDataFrame([(1, "abc", 1, "t", 2)], ITEMS)
    assert lx.ranked(spark.createDataFrame([], SCHEMA), items).collect() == []
    assert lx.ranked(docs, items.limit(0)).collect() == []


def test_pruning_leaves_few_accumulators(spark, monkeypatch):
    """Behind the owners of rare terms, documents that hold common ones alone are left behind."""
    rng = random.Random(9)
    docs = [(i, zipf_text(rng, 200)) for i in range(600)]
    items = [(i, zipf_text(rng, 30)) for i in range(6)]
    df = frame(spark, [(d, x, "en", "a", 0, "t", 1, "c") for d, x in docs])
    left = []
    prune = lx._pruned

    def counted(*args):
        out = prune(*args)
        left.append(sum(len(r["acc"]) // 12 for r in out.collect()))
        return out

    monkeypatch.setattr(lx, "_pruned", counted)
    got = lx.ranked(df, spark.createDataFrame([(i, x, 0, "", 0) for i, x in items], ITEMS), k=3, shard_docs=100)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 3)
    assert left[0] < len(docs) * len(items) / 2, left


def test_long_text_in_segments(monkeypatch):
    text = " ".join(f"Wort{k % 37}" for k in range(2000)) + "é" * 300
    whole = lx.term_counts(text.encode(), lx._Hashes())
    monkeypatch.setattr(lx, "SEGMENT_BYTES", 50)
    parts = lx.term_counts(text.encode(), lx._Hashes())
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
