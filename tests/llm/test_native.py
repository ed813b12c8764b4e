"""Conversations and url filters against plain Python."""

import datetime
import hashlib

from loomspark.llm import conversations as cv
from loomspark.llm import url_filters as uf


def brute(rows, part_turns=cv.PART_TURNS):
    mark = lambda v: "-" if v is None else f"{len(v)}:{v}"
    convs = {}
    for k, (c, t, r, x) in enumerate(dict.fromkeys(rows)):
        digest = hashlib.sha256((mark(r) + mark(x)).encode()).hexdigest()
        convs.setdefault(c if c is not None else f"row {k}", []).append(((t is not None, t or 0), digest, r, x))
    seqs = {c: tuple((r, x) for _, _, r, x in sorted(v, key=lambda t: t[:2])) for c, v in convs.items()}
    prefixes = {s[:k] for s in seqs.values() for k in range(1, len(s))}
    first = {}
    for c, s in seqs.items():
        named = c if isinstance(c, int) else None
        if s not in first or (named is not None and (first[s] is None or named < first[s])):
            first[s] = named
    out = []
    for s, c in first.items():
        if s not in prefixes:
            out += [(c, k // part_turns, len(s), "".join(f"<|{r or ''}|>\n{x or ''}<|end|>\n" for r, x in s[k : k + part_turns])) for k in range(0, len(s), part_turns)]
    return sorted(out, key=repr)


def test_collapse(spark):
    rows = []
    for c in range(30):  # snapshots of five conversations, some equal
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"base {c % 5} turn {t}") for t in range(c % 7 + 1)]
    rows += [(100, 0, "user", None), (101, 0, "user", ""), (102, 0, None, "x"), (103, None, "user", "a"), (103, 0, "bot", "b"), (104, 0, "b", "2"), (104, 0, "a", "1"), (104, 0, "a", "1")]
    rows += [(None, 0, "user", "alone"), (None, 0, "user", "alone"), (None, 1, "user", "alone"), (None, None, "user", "other"), (None, 0, "user", "base 1 turn 0"), (105, 3, "user", "other")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, hash string")
    assert sorted(map(tuple, cv.collapse(df).collect()), key=repr) == brute(rows)
    assert cv.collapse(df.limit(0)).collect() == []


def test_long_conversation_and_many_rows_without_id(spark):
    """One conversation with a third of all turns, a snapshot of it, rows without an id, many turns of one number."""
    long_ = [(7, t, "user", f"turn {t}") for t in range(2500)]
    rows = long_ + [(8, t, r, x) for _, t, r, x in long_[:1800]] + [(None, t % 3, "bot", f"row {t % 900}") for t in range(2500)] + [(9, 0, "bot", f"same turn {t}") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = sorted(map(tuple, cv.collapse(df, 500).collect()), key=repr)
    assert got == brute(rows, 500)
    assert [r[1] for r in got if r[0] == 7] == [0, 1, 2, 3, 4] and not any(r[0] == 8 for r in got)


def test_plan_is_native(spark, small):
    for f in (cv.op2_chat_collapse, uf.op3_url_filters):
        plan = f(spark, small)._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_intervals_and_as_of(spark):
    events = spark.createDataFrame(
        [("bad.example", "add", day(10)), ("bad.example", "add", day(12)), ("bad.example", "remove", day(20)), ("bad.example", "add", day(30)), ("x.bad.example", "add", day(15)), ("gone.example", "remove", day(5)), (None, "add", day(1)), ("odd.example", "other", day(1))],
        "entry string, action string, on date",
    )
    urls = [
        (1, "http://bad.example/", 9, None), (2, "http://bad.example/", 10, "bad.example"), (3, "https://a.bad.example:80/x", 19, "bad.example"), (4, "http://bad.example/", 20, None), (5, "http://BAD.example", 31, "bad.example"),
        (6, "http://u:p@x.bad.example/?q", 16, "x.bad.example"), (7, "http://notbad.example/", 16, None), (8, "http://gone.example/", 9, None), (9, None, 9, None), (10, "no url", 9, None), (11, "http://bad.example/", None, None),
    ]
    rows = [(i, u, day(d) if d is not None else None, "e") for i, u, d, _ in urls]
    captures = spark.createDataFrame([*rows, rows[1]], "page_id long, url string, fetched_on date, entry string")
    got = {r.page_id: r for r in uf.evaluate(captures, events).collect()}
    assert len(got) == len(urls)
    assert {i: got[i].entry for i, *_ in urls} == {i: e for i, _, _, e in urls}
    assert all(r.blocked == (r.entry is not None) for r in got.values())
    assert got[5].listed_on == day(30) and got[3].listed_on == day(10)
    assert uf.evaluate(captures.limit(0), events).collect() == []
    assert not any(r.blocked for r in uf.evaluate(captures, events.limit(0)).collect())


def test_addresses_and_trailing_dots(spark):
    """Addresses are held against whole entries only; a dot at the end of a host says nothing."""
    events = spark.createDataFrame([(e, "add", day(1)) for e in ("2.3", "10.1.2.3", "[2001:db8::1]", "db8::1]", "example.com", "Upper.example.", "0x1.0x2")], "entry string, action string, on date")
    cases = {
        "http://10.1.2.3/": "10.1.2.3", "http://9.1.2.3/x": None, "http://1.2.3": None, "https://[2001:DB8::1]:8080/": "[2001:db8::1]", "https://u:p@[2001:db8::2]/": None, "http://a.b.example.com./": "example.com",
        "http://example.com..:80": "example.com", "http://x.UPPER.example/": "upper.example", "http://user@evil@sub.example.com/": "example.com", "http://7.0x1.0x2/": None, "http://0x1.0x2/": "0x1.0x2", "http://./": None, "http://v2.3.com": None,
    }
    captures = spark.createDataFrame([(i, u, day(5)) for i, u in enumerate(cases)], "page_id long, url string, fetched_on date")
    got = {r.url: r.entry for r in uf.evaluate(captures, events).collect()}
    assert got == cases
