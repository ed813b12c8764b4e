"""Statistics from changes, ranges in ranges, diversity with memory, neighbourhoods with quotas."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import bm25, graph, ranges, ranking


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_statistics_of_changes_equal_a_full_build(spark):
    rng = random.Random(2)
    chunk = lambda texts: spark.createDataFrame([(t,) for t in texts], "content string")
    text = lambda: " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 8)))
    now = [text() for _ in range(40)] + [None, ""]
    stats = bm25.full_statistics(chunk(now))
    for batch in (1, 2, 3):
        gone, come = [now.pop(rng.randrange(len(now))) for _ in range(6)], [text() for _ in range(rng.randint(3, 9))]
        now += come
        before = stats
        stats = bm25.changed_statistics(stats, chunk(gone), chunk(come), batch)
        again = bm25.changed_statistics(stats, chunk(gone), chunk(come), batch)
        assert again is stats and before is not stats
        whole = bm25.full_statistics(chunk(now), batch)
        assert rows(stats.terms, "term", "df") == rows(whole.terms, "term", "df")
        assert stats.corpus.select("n", "total", "batch").first() == whole.corpus.select("n", "total", "batch").first()
    empty = bm25.changed_statistics(stats, chunk(now), chunk([]), 4)
    assert empty.terms.count() == 0 and tuple(empty.corpus.select("n", "total").first()) == (0, 0)


def test_index_reads_only_pages_of_few_terms(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"f{i % 3}", f"alpha w{i} w{i % 5} beta beta" if i else None, "block") for i in range(50)], "chunk_id long, rel_path string, content string, chunk_type string")
    index = bm25.write_index(chunks, str(tmp_path / "i"))
    assert index.chunks.columns == [*chunks.columns, "dl", "weight"] and rows(index.chunks.filter("chunk_id < 2"), "chunk_id", "dl") == [(0, 0), (1, 5)]
    assert index.postings.filter("term = 'beta'").select("tf").distinct().first()[0] == 2
    for part in index.postings.withColumn("_f", F.input_file_name()).groupBy("_f").agg(F.collect_list("term").alias("t")).collect():
        assert part.t == sorted(part.t)
    few, many = spark.createDataFrame([("beta",), ("w3",)], "term string"), spark.createDataFrame([(f"w{i}",) for i in range(30)], "term string")
    assert "In(term" in bm25.postings_of(index, few)._jdf.queryExecution().toString()
    assert bm25.postings_of(index, many) is index.postings and bm25.postings_of(index, few.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_ranges_in_ranges(spark, width):
    rng = random.Random(width)
    outer = [(rng.randrange(3), i, a, a + rng.randint(-1, 40)) for i in range(60) for a in [rng.randint(-5, 200)]] + [(0, 99, 0, 10_000)]
    inner = [(rng.randrange(3), 100 + i, a, a + rng.randint(0, 12)) for i in range(80) for a in [rng.randint(-5, 220)]] + [(1, 300, None, 4)]
    got = ranges.contained(spark.createDataFrame(outer, "f int, o int, s int, e int"), spark.createDataFrame(inner, "f int, i int, a int, b int"), ["f"], ("s", "e"), ("a", "b"), width)
    want = sorted((o, i) for f, o, s, e in outer for g, i, a, b in inner if f == g and a is not None and s <= a and b <= e)
    assert rows(got, "o", "i") == want
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()


def brute_diversity(items, penalty):
    """items (score, tokens) in order."""
    kept = []
    for r, (s, t) in enumerate(items, 1):
        most = max((len(set(t) & k) / len(set(t) | k) if set(t) | k else 0.0 for k in kept), default=0.0)
        if len(items) <= 3 or r <= 5 or (1 - penalty) * s - penalty * most * s > 0:
            kept.append(set(t))
            yield r


@pytest.mark.parametrize("penalty", [0.1, 0.6, 0.9])
def test_diversity(spark, penalty):
    rng = random.Random(4)
    lists = {q: [(s, [f"t{rng.randrange(8)}" for _ in range(rng.randint(0, 6))]) for s in sorted((rng.randint(-2, 50) for _ in range(n)), reverse=True)] for q, n in enumerate([0, 1, 3, 4, 12, 40])}
    data = [(q, r, float(s), t if r != 2 else None) for q, items in lists.items() for r, (s, t) in enumerate(items, 1)]
    df = spark.createDataFrame(data, "query_id int, r int, score double, words array<string>")
    want = sorted((q, r) for q, items in lists.items() for r in brute_diversity([(s, t if k != 1 else []) for k, (s, t) in enumerate(items)], penalty))
    assert rows(ranking.diversity(df, [F.col("r")], penalty, "words"), "query_id", "r") == want
    assert rows(ranking.diversity(df, [F.col("r")], penalty), "query_id", "r") == [(q, r) for q, r, s, _ in data if len(lists[q]) <= 3 or r <= 5 or s > 0]


@pytest.mark.parametrize("limit", [3, 10, 500])
def test_quota_gives_what_a_late_cut_gives(spark, limit):
    rng = random.Random(limit)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", "call") for _ in range(150)]
    df, seeds = spark.createDataFrame(edges, "src string, dst string, kind string"), spark.createDataFrame([("n1",), ("n2",), ("alone",)], "node string")
    near = {n: {b for a, b, _ in edges if a == n} | {a for a, b, _ in edges if b == n} for n in {x for e in edges for x in e[:2]}}
    want, pairs = [], []
    for seed in ("n1", "n2", "alone"):
        hop, ring = {seed: 0}, [seed]
        for k in (1, 2, 3):
            ring = {m for n in ring for m in near.get(n, ())} - set(hop)
            hop |= dict.fromkeys(ring, k)
        kept = sorted(hop.items(), key=lambda x: (x[1], x[0]))[:limit]
        want += [(seed, n, h) for n, h in kept]
        inside = dict(kept)
        own = [(min(inside[a], inside[b]), max(inside[a], inside[b]), a, b) for a, b, _ in edges if a in inside and b in inside and min(inside[a], inside[b]) < 3]
        pairs += [(seed, a, b) for _, _, a, b in sorted(own)[:limit]]
    nodes = graph.neighbourhood(df, seeds, 3, limit)
    assert rows(nodes, "seed", "node", "hop") == sorted(want)
    assert rows(graph.neighbourhood_edges(df, nodes, 3, limit), "seed", "src", "dst") == sorted(pairs)
