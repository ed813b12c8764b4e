import bisect
import hashlib
import random

import numpy as np
import pytest
from cases import frame, odd_documents, words
from pyspark.sql import functions as F

from loomspark.llm import fingerprints as fp
from loomspark.llm.shingles import shingle_set, word_hashes


def brute(spark, rows):
    """The contract of op1 over (doc_id, text), one row after another; rows of one id go by the hash of their texts."""
    hashes = dict(spark.createDataFrame([(r[1] or "",) for r in rows], "t string").select("t", F.xxhash64("t")).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1] or ""]))
    out = []
    for k, (doc_id, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1] or ""
        text = text or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        own, other, after = (fp.fingerprint(fp.signature(x)) for x in (text, edited, following))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(fp.likeness(own, other), 9), round(fp.likeness(own, after), 9)))
    return sorted(out, key=repr)


def test_edited_texts_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i * 3 % 97, words(rng, rng.randint(0, 40))) for i in range(97)]
    hot = [(7, words(rng, 5)) for _ in range(60)] + [(None, words(rng, 5)) for _ in range(60)] + [(i, words(rng, 5)) for i in range(40)] + [(7, "same text")] * 9
    for data in (rows, [(r[0], r[1]) for r in odd_documents()], [(5, "only one text here now")], hot, [(None, "a b"), (None, "c d")]):
        docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        got = fp.edited_fingerprints(docs).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr) == brute(spark, data)


def test_ids_of_many_rows_are_cut(spark):
    places = [fp._place(7, h << 48) for h in range(-30000, 30000, 100)] + [fp._place(None, h << 48) for h in range(-30000, 30000, 100)] + [fp._place(i, 0) for i in range(100)]
    borders = fp._borders([3, 7, 7, 7, 7, 50], 0.4, 10)
    ranges = [bisect.bisect_right(borders, p) for p in sorted(places)]
    assert ranges == sorted(ranges)
    assert len(set(ranges[-600:])) == 4 and len({bisect.bisect_right(borders, p) for p in places[:600]}) == 4


def test_equal_texts_have_equal_fingerprints(spark):
    got = {}
    for r in fp.edited_fingerprints(frame(spark, odd_documents())).collect():
        got.setdefault(r.doc_id, r)
    assert got[4].fingerprint == got[5].fingerprint  # shingles ignore the case of A-Z
    assert got[8].fingerprint == got[9].fingerprint
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint


def test_empty_table(spark):
    assert fp.edited_fingerprints(frame(spark, [])).collect() == []
    assert fp.near_duplicates(frame(spark, [])).collect() == []


def test_likeness_follows_jaccard():
    rng = random.Random(2)
    a = words(rng, 400)
    b = " ".join([*a.split()[:300], *words(rng, 100).split()])
    s, t = shingle_set(a), shingle_set(b)
    both = len(np.intersect1d(s, t))
    true = both / (len(s) + len(t) - both)
    assert abs(fp.likeness(fp.fingerprint(fp.signature(a)), fp.fingerprint(fp.signature(b))) - true) < 0.15


def test_likeness_of_very_long_texts():
    rng = np.random.default_rng(3)
    a, b = ([str(x) for x in rng.integers(0, 10**9, 200_000)] for _ in range(2))
    edited = a[:133_333] + b[:66_667]
    x, y, z = (fp.fingerprint(fp.signature(" ".join(w))) for w in (a, b, edited))
    assert x != y and fp.likeness(x, y) < 0.02
    assert abs(fp.likeness(x, z) - 0.5) < 0.15  # two thirds of the shingles of each are the other's


def test_picks_are_the_smallest_of_each_permutation():
    text = words(random.Random(5), 300)
    whole = shingle_set(text)
    for j, got in enumerate(fp.signature(text)):
        order = min(((int(fp._A[j, 0]) * (int(h) >> 32) + int(fp._B[j, 0])) % 2**32, int(h)) for h in whole)
        assert got == int(fp.mix64(np.array([order[1]], dtype=np.uint64) ^ fp._SALT[j])[0]) >> 32


def test_words_are_split_at_ascii_white_space():
    text = "Aa bB\x0bcc dd\x1cee\n\nff"
    assert len(word_hashes(text)) == len(text.encode().split())
    assert word_hashes("ABC def")[0] == word_hashes("abc")[0]


def test_near_duplicates(spark):
    got = {r.doc_id: r.class_id for r in fp.near_duplicates(frame(spark, odd_documents())).collect()}
    assert got[4] == got[5] == 4 and got[6] == 4  # one changed word of 60 leaves 51 of 61 shingles
    assert got[8] == got[9] == 8
    assert got[1] == 1 and got[2] == 2 and got[3] == 3
    assert got[None] is None


def jaccard(a, b):
    s, t = set(shingle_set(a).tolist()), set(shingle_set(b).tolist())
    return len(s & t) / len(s | t)


def linked_classes(rows, least=0.8):
    """Components over all pairs of texts."""
    sets = {i: set(shingle_set(t).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, pairs


def passage_documents(seed, n_docs, pieces, changed):
    """Documents of shared passages; some have a near copy with a few passages exchanged."""
    rng = random.Random(seed)
    passages = [words(rng, 12) for _ in range(40)]
    rows = []
    for i in range(n_docs):
        own = rng.sample(passages, pieces)
        rows.append((i, " ".join(own)))
        if i % 5 == 0:
            copy = list(own)
            for k in rng.sample(range(pieces), changed):
                copy[k] = rng.choice(passages)
            rows.append((10_000 - i, " ".join(copy)))
    return rows


@pytest.mark.parametrize(("pieces", "changed"), [(8, 0), (12, 1), (20, 1)])
def test_no_link_is_lost_among_documents_of_shared_passages(spark, monkeypatch, pieces, changed):
    monkeypatch.setattr(fp.blocks, "BLOCK_SETS", 64)
    rows = passage_documents(pieces, 300, pieces, changed)
    want, pairs = linked_classes(rows)
    got = {r.doc_id: r.class_id for r in fp.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(pairs) >= 20
    kept = sum(got[a] == got[b] for a, b in pairs)
    assert kept >= 0.99 * len(pairs)
    assert all(want[i] == want[c] for i, c in got.items())  # classes hold nothing that is not linked


def test_link_between_documents_that_a_smaller_one_hides(spark):
    """Two linked documents share all their bands with many that link with neither."""
    rng = random.Random(9)
    base = words(rng, 300).split()
    rows = []
    for i in range(400):  # each of these keeps most of the words of both, not enough to link
        w = list(base)
        for at in range(i % 11, 300, 23):
            w[at] = words(rng, 1)
        rows.append((i, " ".join(w)))
    a = list(base)
    a[5:11] = words(rng, 6).split()
    rows += [(1000, " ".join(a)), (1001, " ".join(a[:280] + words(rng, 16).split()))]
    assert jaccard(rows[-1][1], rows[-2][1]) >= 0.8
    want, pairs = linked_classes(rows)
    got = {r.doc_id: r.class_id for r in fp.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (1000, 1001) in pairs and got[1000] == got[1001]
    assert sum(got[x] == got[y] for x, y in pairs) >= 0.99 * len(pairs)


def test_edited_fingerprint_is_that_of_the_edited_text():
    rng = random.Random(11)
    texts = ["", "a", "a b", "a b c d", "é" * 9, "one two three four five six", " \n ", *(words(rng, rng.randint(1, 60)) for _ in range(60)), *("".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 40))) for _ in range(300))]
    for _ in range(1500):
        text, following = rng.choice(texts), rng.choice(texts)
        edited, got = fp.Signed(text.encode()).edited(following)
        n = len(text) // 3
        want = text[: len(text) - n] + following[:n]
        assert edited.decode() == want and got == fp.fingerprint(fp.signature(want)), (text, following)


def test_query_has_classes_and_all_rows(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want, pairs = linked_classes(docs)
    got = fp.op1_fingerprints(spark, small).collect()
    assert len(got) == len(docs)
    classes = {r.doc_id: r.class_id for r in got}
    assert sum(classes[a] == classes[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(want[i] == want[c] for i, c in classes.items())
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr) == brute(spark, docs)


def test_blocks_compare_as_all_pairs():
    rng = np.random.default_rng(4)
    bases = [rng.integers(0, 2**63, 60, dtype=np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([rng.choice(bases[k % 6], 56, replace=False), rng.integers(0, 2**63, 2, dtype=np.uint64)])) for k in range(60)] + [np.empty(0, np.uint64)]
    component = np.arange(61) // 2
    i, j = fp.blocks.compare(sets, component, 80)
    want = set()
    for a in range(61):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if component[a] != component[b] and len(sets[a]) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                want.add((min(component[a], component[b]), max(component[a], component[b])))
    assert {(min(component[a], component[b]), max(component[a], component[b])) for a, b in zip(i, j, strict=True)} == want and len(want) > 50
