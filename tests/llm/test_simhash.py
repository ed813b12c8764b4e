"""Fingerprints and their links against plain Python over all pairs."""

import random
import re

import pytest
from cases import SCHEMA, frame, odd_documents, words
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loomspark.llm import simhash as sh


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall("[^\\x20\\x09-\\x0D]+", low)
    grams = [" ".join(found[k : k + 3]) for k in range(max(1, len(found) - 2))] if found else []
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    """The smallest id reachable of each row."""
    kinds = sorted(set(prints))
    root = {p: p for p in kinds}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, p in enumerate(kinds):
        for q in kinds[:k]:
            if (p ^ q).bit_count() <= 2:
                root[find(p)] = find(q)
    best = {}
    for i, p in zip(ids, prints, strict=True):
        if i is not None:
            best[find(p)] = min(best.get(find(p), i), i)
    return [best.get(find(p)) for p in prints]


def test_odd_documents(spark):
    rng = random.Random(11)
    rows = odd_documents()
    base = [words(rng, 400) for _ in range(6)]
    for k in range(120):  # near copies: a word changed, some of them twice
        own = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = words(rng, 1)
        rows.append((100 + k, " ".join(own), "en", "a", 0, "x", 1, "y"))
    rows += [(5, words(rng, 30), "en", "a", 0, "x", 1, "y"), (300, None, None, None, None, None, None, None), (301, "A b\x0bC\x1cd", "", "", 0, "", 0, "")]
    prints = [brute_print(r[1]) for r in rows]
    expected = sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute_components([r[0] for r in rows], prints), strict=True), key=repr)
    got = sh.simhash_components(frame(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected
    assert len({c for _, _, c in expected}) < len({f for _, f, _ in expected})
    assert sh.simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("width", [2, 4])
def test_links_of_crowded_cells(spark, width):
    """Many fingerprints a few bits from one another, so that cells are long, beside scattered ones."""
    rng = random.Random(width)
    centre = rng.getrandbits(64)
    prints = {centre, 0, (1 << 64) - 1, 1 << 63, 3 << 62}
    for _ in range(500):
        p = centre
        for _ in range(rng.randint(0, 4)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(300)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = sh.near_links(df, width)
    assert links.filter("bit_count(src ^ dst) > 2").count() == 0
    labels = dict(map(tuple, sh.common.components(links).collect()))
    ordered = sorted(prints, key=signed)
    smallest = brute_components([signed(p) for p in ordered], ordered)
    assert {signed(p): labels.get(signed(p), signed(p)) for p in ordered} == dict(zip(map(signed, ordered), smallest, strict=True))
    longest = df.select(F.explode(sh.near_cells(sh.popcounts(F.col("fp"), width), width)).alias("c")).groupBy("c").count().agg(F.max("count")).first()[0]
    assert longest > sh.SHORT_CELL
    assert links.count() < 40 * len(prints)  # not the pairs of the long cells


def test_long_text_in_segments(monkeypatch):
    rng = random.Random(5)
    text = words(rng, 3000) + " " + "x" * 5000 + "\t" + words(rng, 10)
    whole = brute_print(text)
    for size in (1, 64, 1000):
        monkeypatch.setattr(sh, "SEGMENT_BYTES", size)
        monkeypatch.setattr(sh, "BLOCK", 100)
        assert sh.fingerprint(text.encode()) == whole
    assert sh.fingerprint(b"") == sh.fingerprint(None) == sh.fingerprint(b" \n") == 0
