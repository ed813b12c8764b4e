import random

import pytest
from cases import frame, odd_documents, words

from loomspark.llm import common
from loomspark.llm import jaccard_join as jj


def brute(rows):
    """Components over all pairs, from sets of word tuples."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(doc_id, []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            for s in sets[a]:
                for t in sets[b]:
                    if s and t and 100 * len(s & t) >= 80 * len(s | t):
                        x, y = find(a), find(b)
                        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: sorted(map(len, v)) for i, v in sets.items()}


def corpus(seed, n=220):
    """Groups of near copies with a few to many changes, a common passage, copies and short texts."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    bases = [words(rng, rng.choice([4, 6, 30, 90, 200])) for _ in range(14)]
    rows = []
    for i in range(n):
        w = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = words(rng, rng.choice([0, 1, 2])).split()
        text = " ".join(w)
        rows.append((i, f"{text} {passage}" if rng.random() < 0.3 else text))
    return rows


@pytest.mark.parametrize("short_list", [2, 48])
def test_matches_brute_force(spark, monkeypatch, short_list):
    monkeypatch.setattr(jj, "SHORT_LIST", short_list)
    monkeypatch.setattr(jj.blocks, "BLOCK_SETS", 16)
    rows = corpus(short_list)
    want, sizes = brute(rows)
    got = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all([r.n_shingles] == sizes[r.doc_id] for r in got)
    assert len(set(want.values())) > 20


def test_odd_rows(spark):
    rows = [r for r in odd_documents() if r[0] is not None]
    got = jj.jaccard_components(frame(spark, rows)).collect()
    want, _ = brute([r[:2] for r in rows])
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got}[1] == 0


def test_null_id_and_empty_table(spark):
    assert len(jj.jaccard_components(frame(spark, odd_documents())).collect()) == len(odd_documents())
    assert jj.jaccard_components(frame(spark, [])).collect() == []
    assert [r.component_id for r in jj.jaccard_components(frame(spark, [(1, None, None, None, None, None, None, None)])).collect()] == [1]


def test_bounds():
    for n in range(1, 400):
        assert jj.need(n) * 100 >= 80 * n > (jj.need(n) - 1) * 100
        for m in range(jj.need(n), n + 1):
            assert jj.least_margin(n) <= min(jj.margin(m), jj.margin(n))


def test_components_of_a_shuffled_chain(spark):
    ids = list(range(1000))
    random.Random(6).shuffle(ids)
    edges = [*zip(ids, ids[1:]), (2001, 2000), (2002, 2001)]  # noqa: B905
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == dict.fromkeys(range(1000), 0) | dict.fromkeys(range(2000, 2003), 2000)
