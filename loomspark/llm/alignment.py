"""Operator 12, cross-tokenizer alignment by an associative monoid of fragments.

A text is encoded by two tokenizers, A (byte-level BPE, a space put before the text) and B (pieces with byte fallback, which puts a
space there itself).  Byte offsets where tokens of both end are borders; they cut the tokens into groups, and an A and a B token
link where their byte ranges overlap.

A fragment describes the tokens that end in one byte range of a text: an open prefix up to the range's first border, the closed
groups between its first and last border (their text, counts and links), and an open suffix.  Fragments compose: the suffix of
one and the prefix of the next make a closed group, or stay open where a side has no border.  Composition is associative, so
that fragments of a very long text, made by different tasks, are composed by a tree of grouped reductions; what is
left open at the text's start closes there.

Texts up to FRAGMENT_BYTES are one range, in one pass over the scan.  Tokens of a range are exact although no task sees more than the
range and what touches it: neither tokenizer joins across a single blank between two other characters or behind a single
line feed between such, and stretches between these (units) are encoded whole.  That no piece of B continues with a blank is
verified; otherwise a text is one unit.  A unit that is longer than a range is never cut.

Per id pair, the number of documents that hold it linked is summed over the corpus; each document's links then meet these
counts, frequent pairs by a broadcast of bounded size and the others by a shuffled join, so that no hot pair is shuffled.

Defined results: null and empty texts, and those whose tokens' joined bytes differ from the text, have no tokens: zeros and an
empty string, and they count for no pair; each row is a document of its own; a row without an id keeps it null; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import common
from loomspark.llm.token_counts import byte_symbols

#: Bytes of a range; longer texts are dealt over tasks.
FRAGMENT_BYTES = 1 << 16
#: Fragments composed by one task of one level of the tree.
FAN = 32
#: Units, and bytes of units, that a worker remembers.
MEMO_UNITS, MEMO_BYTES = 500_000, 96 << 20
#: Id pairs (with two counts, some 60 bytes each) that are broadcast at most.
BROADCAST_PAIRS = 1_000_000
_BLANK, _FEED = "▁", "<0x0A>"
_RUN = re.compile(r"\s\s")
_LINE = re.compile(r"(?<=\S\n)(?=\S)")
_LINE_END = re.compile(r"\S\n\Z")
#: Put between units of different texts that would touch otherwise: before a line, before a run of white space.
_BEFORE_LINE, _BEFORE_RUN = " a\n", " a"
#: Longer units are cut at line feeds too.
LONG_UNIT = 64


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Tokens:
    """Tokens of both kinds in order, with the byte offsets of their ends in the text."""

    a: list[int] = field(default_factory=list)
    a_ends: list[int] = field(default_factory=list)
    b: list[int] = field(default_factory=list)
    b_ends: list[int] = field(default_factory=list)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(self.a + other.a, self.a_ends + other.a_ends, self.b + other.b, self.b_ends + other.b_ends)

    def between(self, lo: int, hi: int) -> Tokens:
        """The tokens that end behind lo, and at hi at most."""
        (i, j), (k, n) = (np.searchsorted(ends, [lo, hi], side="right").tolist() for ends in (self.a_ends, self.b_ends))
        return Tokens(self.a[i:j], self.a_ends[i:j], self.b[k:n], self.b_ends[k:n])


_NONE = np.empty(0, dtype=np.int64)


def _counted(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their summed counts."""
    if not len(codes):
        return _NONE, _NONE
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.add.reduceat(counts, first)


@dataclass
class Fragment:
    """What the tokens ending in one byte range say; links are codes (A id << 32 | B id) with counts.

    Without a border all tokens are in head.  With one, head ends at the first border and tail begins behind the last.
    """

    border: bool = False
    head: Tokens = field(default_factory=Tokens)
    groups: bytes = b""
    sums: tuple[int, int, int, int] = (0, 0, 0, 0)  # A tokens, B tokens, groups, links that are closed
    codes: np.ndarray = field(default_factory=lambda: _NONE)
    counts: np.ndarray = field(default_factory=lambda: _NONE)
    tail: Tokens = field(default_factory=Tokens)
    ok: bool = True


def closed(t: Tokens) -> Fragment:
    """The groups of tokens that begin and end at a border; each step is one stretch of bytes without an end inside, and so one link."""
    if not t.a:
        return Fragment(border=True)
    parts, links, i, j, first_a, first_b = [], [], 0, 0, 0, 0
    while i < len(t.a):
        links.append(t.a[i] << 32 | t.b[j])
        behind = t.a_ends[i] - t.b_ends[j]
        i += behind <= 0
        j += behind >= 0
        if behind == 0:
            parts.append(f"{','.join(map(str, t.a[first_a:i]))}|{','.join(map(str, t.b[first_b:j]))}")
            first_a, first_b = i, j
    codes, counts = np.unique(np.array(links, dtype=np.int64), return_counts=True)
    return Fragment(True, Tokens(), ";".join(parts).encode(), (len(t.a), len(t.b), len(parts), len(links)), codes, counts)


def fragment(t: Tokens) -> Fragment:
    """The fragment of a range's tokens, of which nothing else is known."""
    borders = np.intersect1d(t.a_ends, t.b_ends, assume_unique=True)
    if not len(borders):
        return Fragment(head=t)
    first, last = int(borders[0]), int(borders[-1])
    out = closed(t.between(first, last))
    out.head, out.tail = t.between(-1, first), t.between(last, 1 << 62)
    return out


def compose(f: Fragment, g: Fragment) -> Fragment:
    """The fragment of two ranges in a row; what does not fit the text makes all of it unfit."""
    if not (f.ok and g.ok):
        return Fragment(ok=False)
    if not f.border:
        return Fragment(g.border, f.head + g.head, g.groups, g.sums, g.codes, g.counts, g.tail)
    if not g.border:
        return Fragment(True, f.head, f.groups, f.sums, f.codes, f.counts, f.tail + g.head)
    middle = closed(f.tail + g.head)
    groups = b";".join(x for x in (f.groups, middle.groups, g.groups) if x)
    sums = tuple(map(sum, zip(f.sums, middle.sums, g.sums, strict=True)))
    codes, counts = _counted(np.concatenate([f.codes, middle.codes, g.codes]), np.concatenate([f.counts, middle.counts, g.counts]))
    return Fragment(True, f.head, groups, sums, codes, counts, g.tail)


def finished(f: Fragment) -> Fragment:
    """A whole text's fragment: both its ends are borders, what stands open there closes, and a text that does not fit has nothing."""
    whole = compose(compose(Fragment(border=True), f), Fragment(border=True))
    return whole if whole.ok else Fragment(border=True)


def in_a_row(units: list[str]) -> tuple[list[str], list[int]]:
    """Units of any texts, none with a blank at its end, in a row that both tokenizers cut where they meet; where each one stands.

    A unit that begins a line is cut off only behind a line's end, one that begins with more white space only behind another character; where
    the unit before it, of another place or text, does not end so, a short unit is put between.
    """
    row: list[str] = []
    own: list[int] = []
    for u in units:
        if row and u[0] != " ":
            if not _LINE_END.search(row[-1], max(0, len(row[-1]) - 2)):
                row.append(_BEFORE_LINE)
        elif row and u[1:2].isspace() and row[-1][-1].isspace():
            row.append(_BEFORE_RUN)
        own.append(len(row))
        row.append(u)
    return row, own


class Aligner:
    """Both tokenizers, and a memo of units."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        symbols = byte_symbols()
        self.bytes_a = {i: bytes(symbols[c] for c in s) if all(c in symbols for c in s) else s.encode() for s, i in self.a.get_vocab().items()}
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.lead = [self.b.piece_to_id(_BLANK), self.b.piece_to_id(_FEED)]
        inner = any(re.search(f"[^{_BLANK}]{_BLANK}|\n", p) for p in pieces)
        self.cuts = not inner and self.b.encode("\na")[:2] == self.lead
        self.size_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        numbers = [str(i) for i in range(max(len(self.size_a), len(pieces)))]
        self.shown = {mark: np.array([n + mark for n in numbers], dtype=object) for mark in ",|;"}
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.sums = np.zeros((1024, 4), dtype=np.int64)
        self.ok = np.zeros(1024, dtype=bool)
        self.links_end = np.zeros(1025, dtype=np.int64)  # of unit k at k + 1
        self.links = np.zeros(8192, dtype=np.int64)
        self.held = 0

    def units(self, text: str) -> list[str]:
        """The text, with the space before it, in units that both tokenizers encode by themselves."""
        if not self.cuts:
            return [" " + text]
        parts = text.split(" ")
        if _RUN.search(text) or text[:1].isspace() or text[-1:].isspace():  # runs of white space stay with what is on both sides
            joined, at = [], 0
            bad = {k for k, p in enumerate(parts) if not p or p[0].isspace() or p[-1].isspace()}
            for k in range(1, len(parts) + 1):
                if k == len(parts) or (k not in bad and k - 1 not in bad):
                    joined.append(" ".join(parts[at:k]))
                    at = k
            parts = joined
        if max(map(len, parts)) <= LONG_UNIT:
            return [" " + p for p in parts]
        out: list[str] = []
        for p in parts:
            out += _LINE.split(" " + p) if len(p) > LONG_UNIT and "\n" in p else (" " + p,)
        return out

    def tokens(self, units: list[str]) -> list[tuple[Tokens, bool]]:
        """Each unit's tokens, their ends counted from its start, and whether their bytes are the unit's."""
        if self.cuts:
            encoded = [ids[2:] for ids in self.b.encode(["\n" + u for u in units], num_threads=1)]
        else:
            encoded = self.b.encode([u[1:] for u in units], num_threads=1)
        out = []
        for unit, a, b in zip(units, self.a.encode_batch(units, add_special_tokens=False), encoded, strict=True):
            raw_a, raw_b, data = [self.bytes_a[i] for i in a.ids], [self.bytes_b[i] for i in b], unit.encode("utf-8")
            ends_a, ends_b = np.cumsum([*map(len, raw_a)]).tolist(), np.cumsum([*map(len, raw_b)]).tolist()
            out.append((Tokens(list(a.ids), ends_a, list(b), ends_b), b"".join(raw_a) == data == b"".join(raw_b)))
        return out

    def entries(self, units: list[str]) -> np.ndarray:
        """The units' numbers in the memo; call `rest` between texts, as numbers may then be given anew."""
        known = self.number.get
        at = list(map(known, units))
        if None in at:
            fresh = list(dict.fromkeys(u for u, k in zip(units, at, strict=True) if k is None))
            self._learn([u for u in fresh if _BLANK in u], fits=False)
            fresh = [u for u in fresh if _BLANK not in u]
            self._learn([u for u in fresh if u[-1] != " "])
            for u in fresh:
                if u[-1] == " ":  # B joins a blank at the end with the next unit's
                    self._learn([u])
            at = list(map(known, units))
        return np.array(at, dtype=np.int64)

    def _learn(self, units: list[str], fits: bool = True) -> None:
        """Add units to the memo; where they can be encoded in a row, all at once."""
        if not units:
            return
        first, sizes = len(self.groups), [len(u.encode("utf-8")) for u in units]
        while first + len(units) > len(self.ok):
            self.sums, self.ok = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.ok, np.zeros_like(self.ok)])
            self.links_end = np.concatenate([self.links_end, np.zeros(len(self.links_end) - 1, np.int64)])
        here = slice(first, first + len(units))
        links = made = None
        if fits and self.cuts:
            row, own = in_a_row(units)
            made = self._in_a_row("".join(row), np.cumsum([len(u.encode("utf-8")) for u in row]), own)
        if made is None and fits and len(units) > 1:  # one of them does not fit
            self._learn(units[: len(units) // 2])
            self._learn(units[len(units) // 2 :])
            return
        if made is None and fits and not self.cuts:
            ((t, ok),) = self.tokens(units)
            f = closed(t) if ok else Fragment(ok=False)
            made = ok, [f.groups], np.array([f.sums]), np.repeat(f.codes, f.counts), np.array([len(f.codes) and f.counts.sum()])
        if made is None:
            self.groups += [b""] * len(units)
            self.ok[here], self.sums[here] = False, 0
            links, ends = _NONE, np.zeros(len(units), np.int64)
        else:
            self.ok[here], groups, self.sums[here], links, ends = made
            self.groups += groups
        used = int(self.links_end[first])
        while used + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[used : used + len(links)] = links
        self.links_end[first + 1 : first + 1 + len(units)] = used + ends
        self.number.update(zip(units, range(first, first + len(units)), strict=True))
        self.held += sum(sizes) + sum(map(len, self.groups[first:])) + 8 * len(links)

    def _in_a_row(self, text: str, unit_ends: np.ndarray, own: list[int]) -> tuple | None:
        """(fits, groups, sums, links, ends of links) of some of the units that a text consists of, or None where it does not fit."""
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        b = np.array(self.b.encode("\n" + text)[2:], dtype=np.int64)
        if b"".join(map(self.bytes_b.__getitem__, b.tolist())) != text.encode("utf-8"):
            return None
        a_ends, b_ends = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        borders = np.intersect1d(a_ends, b_ends, assume_unique=True)
        ends = np.union1d(a_ends, b_ends)
        codes = a[np.searchsorted(a_ends, ends)] << 32 | b[np.searchsorted(b_ends, ends)]
        # the groups' text: of each group its A ids, then its B ids, each with what follows it
        a_group, b_group = np.searchsorted(borders, a_ends), np.searchsorted(borders, b_ends)
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        marked = np.concatenate([np.where(a_ends == borders[a_group], self.shown["|"][a], self.shown[","][a]), np.where(b_ends == borders[b_group], self.shown[";"][b], self.shown[","][b])])
        parts = marked[order].tolist()
        upto = lambda of: np.searchsorted(of, unit_ends, side="right")
        counts = np.stack([upto(x) for x in (a_ends, b_ends, borders, ends)], axis=1)
        tokens = (counts[:, 0] + counts[:, 1]).tolist()
        groups = ["".join(parts[i:j])[:-1].encode() for i, j in zip([0, *tokens[:-1]], tokens, strict=True)]
        if len(own) == len(groups):
            return True, groups, np.diff(counts, axis=0, prepend=0), codes, counts[:, 3]
        sums = np.diff(counts, axis=0, prepend=0)
        kept = np.zeros(len(groups), dtype=bool)
        kept[own] = True
        return True, [groups[k] for k in own], sums[own], codes[np.repeat(kept, sums[:, 3])], np.cumsum(sums[own, 3])

    def rest(self) -> None:
        """Between texts: forget all units if they are too many."""
        if len(self.groups) > MEMO_UNITS or self.held > MEMO_BYTES:
            self.reset()

    def whole(self, units: list[str]) -> Fragment:
        """The fragment of whole units, which begin and end at borders."""
        return self.summary(self.entries(units))

    def summary(self, at: np.ndarray) -> Fragment:
        """The fragment of the units with these numbers in a row."""
        if not len(at):
            return Fragment(border=True)
        if not self.ok[at].all():
            return Fragment(ok=False)
        begin = self.links_end[at]
        sizes = self.links_end[at + 1] - begin
        links = self.links[np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)]
        links.sort()
        first = np.flatnonzero(np.append(True, links[1:] != links[:-1]))
        return Fragment(True, Tokens(), b";".join(map(self.groups.__getitem__, at.tolist())), tuple(self.sums[at].sum(axis=0).tolist()), links[first], np.diff(first, append=len(links)))

    def part(self, units: list[str], lo: int, hi: int, base: int) -> Fragment:
        """The fragment of the tokens that end in (lo, hi] of some units, which begin at byte `base` of their text."""
        sizes = [len(u.encode("utf-8")) for u in units]
        ends = (np.cumsum(sizes) + base).tolist()
        first = sum(end - size < lo for end, size in zip(ends, sizes, strict=True))  # units that begin before the range
        last = sum(end <= hi for end in ends)
        out = Fragment(border=first == 0)
        for k in range(min(first, len(units))):
            if ends[k] > lo:
                out = compose(out, self._edge(units[k], ends[k] - sizes[k], lo, hi))
        out = compose(out, self.whole(units[first:last])) if last > first else out
        for k in range(max(first, last), len(units)):
            out = compose(out, self._edge(units[k], ends[k] - sizes[k], lo, hi))
        return out

    def _edge(self, unit: str, start: int, lo: int, hi: int) -> Fragment:
        ((t, ok),) = self.tokens([unit])
        t.a_ends, t.b_ends = [e + start for e in t.a_ends], [e + start for e in t.b_ends]
        if not ok:
            return Fragment(ok=False)
        return fragment(t.between(lo, hi))


def byte_ranges(units: list[str], width: int) -> Iterator[tuple[int, int, int, list[str]]]:
    """(lo, hi, base, units that touch it) for byte ranges of a text; one that would end in a unit longer than a range ends with that unit."""
    ends = np.cumsum([len(u.encode("utf-8")) for u in units])
    starts, total, lo = np.append(0, ends[:-1]), int(ends[-1]), 0
    while lo < total:
        hi = min(lo + width, total)
        k = int(np.searchsorted(ends, hi))  # the unit that holds the range's last byte
        if ends[k] - starts[k] > width:
            hi = int(ends[k])
        first = int(np.searchsorted(ends, lo, side="right"))
        yield lo, hi, int(starts[first]), units[first : k + 1]
        lo = hi


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str] | None) -> Aligner:
    paths = paths or default_vocabularies()
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


_LISTS = ("head_a", "head_a_ends", "head_b", "head_b_ends", "tail_a", "tail_a_ends", "tail_b", "tail_b_ends", "sums", "codes", "counts")
_ROW = [("row", pa.int64()), ("doc_id", pa.int64())]
_FRAGMENT = pa.schema([*_ROW, ("k", pa.int64()), ("border", pa.bool_()), ("ok", pa.bool_()), ("groups", pa.binary()), *((c, pa.list_(pa.int64())) for c in _LISTS)])
_FRAGMENT_DDL = "row long, doc_id long, k long, border boolean, ok boolean, groups binary, " + ", ".join(f"{c} array<long>" for c in _LISTS)


def _fragment_row(row: int, doc_id: int | None, k: int, f: Fragment) -> dict:
    lists = (f.head.a, f.head.a_ends, f.head.b, f.head.b_ends, f.tail.a, f.tail.a_ends, f.tail.b, f.tail.b_ends, list(f.sums), f.codes.tolist(), f.counts.tolist())
    return {"row": row, "doc_id": doc_id, "k": k, "border": f.border, "ok": f.ok, "groups": f.groups} | dict(zip(_LISTS, lists, strict=True))


def _fragment_of(r: dict) -> Fragment:
    head, tail = (Tokens(*(r[f"{side}_{c}"] for c in ("a", "a_ends", "b", "b_ends"))) for side in ("head", "tail"))
    return Fragment(r["border"], head, r["groups"], tuple(r["sums"]), np.array(r["codes"], np.int64), np.array(r["counts"], np.int64), tail, r["ok"])


_ALIGNED = pa.schema([*_ROW, *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.binary()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
_ALIGNED_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary, a array<int>, b array<int>, n array<int>"


def _aligned_batch(rows: list[tuple[int, int | None, Fragment]], keep: bool) -> pa.RecordBatch:
    """Rows of whole texts; groups as they are, or their digest (null without tokens)."""
    made = [finished(f) for _, _, f in rows]
    texts = [f.groups if keep else hashlib.sha256(f.groups).digest() if f.groups else None for f in made]
    sums = np.array([f.sums for f in made], dtype=np.int64).reshape(-1, 4)
    lists = [[(f.codes >> 32).astype(np.int32) for f in made], [(f.codes & 0xFFFFFFFF).astype(np.int32) for f in made], [f.counts.astype(np.int32) for f in made]]
    columns = [pa.array([r for r, _, _ in rows], pa.int64()), pa.array([d for _, d, _ in rows], pa.int64()), *(pa.array(c) for c in sums.T), pa.array(texts, pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.list_(pa.int32())) for x in lists)], schema=_ALIGNED)


def aligned(docs: DataFrame, vocabularies: tuple[str, str] | None = None, fragment_bytes: int = FRAGMENT_BYTES, fan: int = FAN, keep_groups: bool = True) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, a, b, n) for each document.

    groups is their text (A ids | B ids; ...), or with keep_groups false its SHA-256; a, b and n are linked id pairs and how
    often each is linked; row is a number of the row's own.
    """
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long_ = F.octet_length("text") >= fragment_bytes  # a space comes before the text

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        al, row = aligner(vocabularies), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, common.STEP_ROWS):
                part, made = batch.slice(at, common.STEP_ROWS), []
                al.rest()
                units = [al.units(text) if text else [] for text in part.column(1).to_pylist()]
                numbers, end = al.entries([u for own in units for u in own]), 0
                for doc_id, own in zip(part.column(0).to_pylist(), units, strict=True):
                    made.append((row, doc_id, al.summary(numbers[end : end + len(own)])))
                    row, end = row + 1, end + len(own)
                yield _aligned_batch(made, keep_groups)

    cut_schema = pa.schema([*_ROW, *((c, pa.int64()) for c in ("k", "lo", "hi", "base")), ("units", pa.list_(pa.string()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        al, row = aligner(vocabularies), TaskContext.get().partitionId() << 40 | 1 << 62
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for k, (lo, hi, base, units) in enumerate(byte_ranges(al.units(text.as_py()), fragment_bytes)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id.as_py(), "k": k, "lo": lo, "hi": hi, "base": base, "units": units}], schema=cut_schema)
                row += 1

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(vocabularies)
        for batch in batches:
            for at in range(batch.num_rows):
                (r,) = batch.slice(at, 1).to_pylist()
                al.rest()
                yield pa.RecordBatch.from_pylist([_fragment_row(r["row"], r["doc_id"], r["k"], al.part(r["units"], r["lo"], r["hi"], r["base"]))], schema=_FRAGMENT)

    def joined(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["k"])
        out = _fragment_of(parts[0])
        for r in parts[1:]:
            out = compose(out, _fragment_of(r))
        return pa.Table.from_pylist([_fragment_row(parts[0]["row"], parts[0]["doc_id"], parts[0]["k"] // fan, out)], schema=_FRAGMENT)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (r,) = batch.slice(at, 1).to_pylist()
                yield _aligned_batch([(r["row"], r["doc_id"], _fragment_of(r))], keep_groups)

    ranges = rows.filter(long_).mapInArrow(cut, "row long, doc_id long, k long, lo long, hi long, base long, units array<string>")
    level = common.stored(ranges.repartition("row", "k").mapInArrow(leaf, _FRAGMENT_DDL))
    while (level.agg(F.max("k")).first()[0] or 0) > 0:
        grouped = level.withColumn("above", F.floor(F.col("k") / fan)).groupBy("row", "above")
        level = common.stored(grouped.applyInArrow(lambda t: joined(t.drop_columns(["above"])), _FRAGMENT_DDL), instead_of=level)
    return rows.filter(~long_).mapInArrow(short, _ALIGNED_DDL).union(level.mapInArrow(ended, _ALIGNED_DDL))


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, df, top): how many documents hold an id pair linked, and whether that is its A id's highest count."""
    pairs = found.select(F.explode(F.arrays_zip("a", "b")).alias("p")).select("p.a", "p.b")
    counted = common.stored(pairs.groupBy("a", "b").agg(F.count("*").alias("df")))
    best = counted.groupBy("a").agg(F.max("df").alias("most"))
    return common.stored(counted.join(best, "a").select("a", "b", "df", (F.col("df") == F.col("most")).alias("top")))


def link_sums(found: DataFrame, counted: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """(row, n_best, count_sum): a document's links whose pair has its A id's highest count, and the sum of its links' counts."""
    classes = {r["c"]: r["count"] for r in counted.groupBy(F.floor(F.log2("df")).cast("int").alias("c")).count().collect()}  # 64 at most
    least, held = 64, 0  # pairs of at least 2**least documents are few enough to be broadcast
    while least > 0 and held + classes.get(least - 1, 0) <= most:
        least -= 1
        held += classes.get(least, 0)
    frequent = F.floor(F.log2("df")).cast("int") >= least
    links = found.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("row", "p.a", "p.b", "p.n")
    hot = links.join(F.broadcast(counted.filter(frequent)), ["a", "b"], "left" if least else "inner")
    met = hot.filter("df is not null").select("row", "n", "df", "top")
    if least:
        met = met.union(hot.filter("df is null").select("row", "a", "b", "n").join(counted.filter(~frequent), ["a", "b"]).select("row", "n", "df", "top"))
    return met.groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("n").cast("long")).otherwise(0)).alias("n_best"), F.sum(F.col("n").cast("long") * F.col("df")).alias("count_sum"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = common.stored(aligned(common.read(spark, sf_dir, "documents"), keep_groups=False))
    sums = link_sums(found, pair_counts(found))
    digest = F.when(F.col("groups").isNull(), "").otherwise(F.lower(F.hex("groups"))).alias("groups_sha256")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *counts, digest)


QUERIES = {"op12_alignment": op12_alignment}
ORACLES: dict[str, str] = {}
