"""Alignment of two tokenizers against both libraries on whole texts."""

import bisect
import hashlib
import random
from collections import Counter

import pytest
from cases import SCHEMA, frame, odd_documents, words

from loomspark.llm import alignment as al


def brute_one(a, text):
    """(A ids, B ids, groups as text, links) from the whole text, or None."""
    if not text:
        return None
    ids_a, ids_b = a.a.encode(" " + text, add_special_tokens=False).ids, a.b.encode(text)
    raw_a, raw_b = [a.bytes_a[i] for i in ids_a], [a.bytes_b[i] for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    spans = []
    for raw in (raw_a, raw_b):
        at, own = 0, []
        for x in raw:
            own.append((at, at + len(x)))
            at += len(x)
        spans.append(own)
    borders = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    sides = [["" for _ in borders] for _ in spans]
    for side, ids, own in zip(sides, (ids_a, ids_b), spans, strict=True):
        for i, (_, e) in zip(ids, own, strict=True):
            k = bisect.bisect_left(borders, e)
            side[k] += f",{i}" if side[k] else str(i)
    groups = ["|".join(x) for x in zip(*sides, strict=True)]
    owners = [[k for k, (s, e) in enumerate(own) for _ in range(s, e)] for own in spans]  # each byte's token
    links = [(ids_a[i], ids_b[j]) for i, j in set(zip(*owners, strict=True))]
    return ids_a, ids_b, ";".join(groups), links


def brute(a, docs):
    found = [(d, brute_one(a, x)) for d, x in docs]
    df = Counter(p for _, f in found if f for p in set(f[3]))
    top = {}
    for (i, _), n in df.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(df[p] == top[p[0]] for p in f[3])
            out.append((d, len(f[0]), len(f[1]), f[2].count(";") + 1, len(f[3]), best, sum(df[p] for p in f[3]), hashlib.sha256(f[2].encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [
    "a  b", " lead", "trail ", "\n", "a\n\nb \n c", "x\x00y", "a▁b", "▁", "<s> x </s> <|endoftext|>", "中文字符没有空格" * 9, "naïve café ½ ﬁ", "don't they'll 's 're", " x y", "🙂👩‍👩‍👧 z", "a\r\nb\tc", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "line one\nline two is longer than the memo takes\nthree\n\nfour\n" * 3, "x\x1cy \x1c z", "١٢٣ 42nd 3.14", "é ́x", "﻿bom", "q" * 200 + "\n" + "w" * 100, "᠎ a ᠎", " ", "  ", "<0x0A>", "end.",
]


@pytest.fixture(scope="module")
def both():
    return al.aligner(None)


def digest(f):
    return (f.groups, f.sums, f.codes.tolist(), f.counts.tolist())


def test_units_are_encoded_alone(both):
    """What both tokenizers make of units in a row is what they make of the text."""
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "中", " ", " ", "  ", "\n", "'", "s", "ll", ".", "1", "\t", "▁", " ", "🙂", "word", "</s>"]
    for text in ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]:
        units = both.units(text)
        assert "".join(units) == " " + text
        f, expected = al.finished(both.whole(units)), brute_one(both, text)
        if expected is None:
            assert f.sums == (0, 0, 0, 0) and not f.groups
        else:
            assert f.groups.decode() == expected[2] and f.sums[3] == len(expected[3])


def test_units_of_many_texts_in_a_row():
    """Lines and runs of white space that are new to the memo beside units of other texts."""
    rng, han = random.Random(5), "中文" * 40
    known = [han + "\nfirst line", "hello zzz", han + "\nsecond\n" + han, "trail ", " lead", "a\n", "  two", "x  ", "next", "y\t", "\n z", han + "\n\n", han + "\nthird line", "0 ▁", han + "\ns are " + han + "\n", "end"]
    made = ["".join(rng.choice([han, "\n", " ", "  ", "\t", "line", "'s", "9", "é", "w" * 70]) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    fresh = al.Aligner(*al.default_vocabularies())
    for at, size in ((0, 1), (1, 3), (4, 8), (12, 4), *((16 + k, 60) for k in range(0, 600, 60))):
        texts = (known + made)[at : at + size]
        units = [fresh.units(text) for text in texts]
        numbers, end = fresh.entries([u for own in units for u in own]), 0
        for text, own in zip(texts, units, strict=True):
            f, expected = al.finished(fresh.summary(numbers[end : end + len(own)])), brute_one(fresh, text)
            end += len(own)
            assert f.groups.decode() == (expected[2] if expected else ""), text
            assert sorted(zip(f.codes.tolist(), f.counts.tolist(), strict=True)) == sorted(Counter(a << 32 | b for a, b in expected[3]).items() if expected else []), text


@pytest.mark.parametrize("width", [1, 2, 5, 16, 1000])
def test_fragments_compose(both, width):
    """Ranges of any width, composed in any order, give what the whole text gives."""
    rng = random.Random(width)
    for text in [*ODD, words(rng, 60) + " café\n" + words(rng, 5) + "…  " + words(rng, 9)]:
        units = both.units(text)
        whole = al.finished(both.whole(units))
        parts = [both.part(u, lo, hi, base) for lo, hi, base, u in al.byte_ranges(units, width)]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [al.compose(parts[k], parts[k + 1])]
        assert digest(al.finished(parts[0])) == digest(whole), text


def test_ranges_do_not_repeat_long_units(both):
    units = both.units("a b " + "x" * 500 + " c d")
    ranges = list(al.byte_ranges(units, 16))
    assert sum(len(u) for *_, own in ranges for u in own if len(u) > 16) == 501
    assert ranges[0][0] == 0 and all(r[1] == s[0] for r, s in zip(ranges, ranges[1:], strict=False))


def test_documents(spark, both):
    rng = random.Random(12)
    docs = [(r[0], r[1]) for r in odd_documents()] + [(100 + k, x) for k, x in enumerate(ODD)] + [(200, words(rng, 3000)), (200, words(rng, 40)), (201, "unfit ▁ " + words(rng, 900)), (202, "y" * 5000)]
    df = frame(spark, [(d, x, "en", "a", 0, "t", 1, "c") for d, x in docs]).repartition(3)
    expected = brute(both, docs)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for width, fan, most in ((al.FRAGMENT_BYTES, al.FAN, al.BROADCAST_PAIRS), (300, 3, 40)):
        found = al.common.stored(al.aligned(df, fragment_bytes=width, fan=fan))
        sums = {r["row"]: (r["n_best"], r["count_sum"]) for r in al.link_sums(found, al.pair_counts(found), most).collect()}
        rows = found.collect()
        assert len({r["row"] for r in rows}) == len(rows)
        got = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], *sums.get(r["row"], (0, 0)), hashlib.sha256(r["groups"]).hexdigest() if r["groups"] else "") for r in rows]
        assert sorted(got, key=repr) == expected
    assert al.aligned(spark.createDataFrame([], SCHEMA)).collect() == []
    assert tuple(al.op12_alignment(spark, "/root/testdata/sf0.001").columns) == names


def test_query(spark, both, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, al.op12_alignment(spark, small).collect()), key=repr) == brute(both, docs)
