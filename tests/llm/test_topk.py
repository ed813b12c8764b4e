import math
import random

from pyspark.sql import functions as F

from loomspark.llm import topk


def brute(rows, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            ok[i] = min(ok[i], w) if i in ok else w
    out = []
    for q, v in ok.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok.items() if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    return sorted(tuple(r) for r in topk.top_k(df.repartition(3), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKETS", (64, 64))
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = random.Random(6)
    rows = []
    for i in range(700):
        scale = rng.choice([0.01, 1, 1, 3])
        rows.append((i, [rng.gauss(0, scale) for _ in range(12)], "x"))
    rows += [(i, list(rows[3][1]), "x") for i in range(700, 760)]  # a very common vector
    rows += [(800, None, "x"), (801, [1.0, None], "x"), (850, [float("nan")] * 12, "x"), (None, [0.5] * 12, "x"), (900, [0.0] * 12, "x"), (5, list(rows[5][1]), "x"), (950, [1.0, 2.0], "x"), (951, [2.0, 2.0], "x")]
    assert run(spark, rows) == brute([r[:2] for r in rows])


def test_few_and_no_rows(spark):
    assert run(spark, [(0, [1.0, 0.0], "x"), (3, [0.5, 0.5], "x")]) == [(0, 1, 3, 128 * 256)]
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], "x")]) == []


def test_blocks_meet_only_buckets_that_can_hold_better(spark, monkeypatch):
    """Long vectors that all queries find in the first pass leave the short ones' buckets unvisited."""
    monkeypatch.setattr(topk, "BUCKETS", (16, 16))
    rng = random.Random(2)
    long_ = [(i, [rng.gauss(0, 9) for _ in range(8)], "x") for i in range(100, 140)]
    short = [(i, [rng.gauss(0, 0.01) for _ in range(8)], "x") for i in range(1000, 1400)]
    seen = []
    monkeypatch.setattr(topk, "_search", lambda pairs, k, f=topk._search: (seen.append(pairs), f(pairs, k))[1])
    assert run(spark, long_ + short) == brute([r[:2] for r in long_ + short])
    pairs = seen[0].select("first", "range", "part").collect()
    assert len(pairs) < 0.7 * len({(r["range"], r["part"]) for r in pairs} | {(0, k) for k in range(26)}) * len({r["first"] for r in pairs})


def test_huge_components(spark):
    rows = [(i, [float(1 << (20 + i % 3)), float(i)], "x") for i in range(0, 120, 10)]
    assert run(spark, rows) == brute([r[:2] for r in rows])


def test_plan_has_no_cross_join(spark, small):
    plan = topk.op9_top_k(spark, small)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
