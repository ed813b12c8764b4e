"""Operator 7, token counts: a byte-level BPE compiled to finite-state transducers.

Two deterministic machines count the tokens of a text.

* ``ByteBPE`` compiles the merge table to a transducer over the bytes of one pre-token.  Its state after
  a prefix is what later tokens can depend on: the node of the longest suffix that begins a vocabulary
  entry, and for each such start the last token and the token count (relative to now).  A transition
  carries the tokens it emits, which may be fewer than none when a longer token swallows earlier ones.
  States and transitions are compiled when first met; a walked pre-token leaves a macro transition from
  the start state to itself.
* ``Splitter`` is the machine over the characters of a text: its state is what it is inside of (a run of letters,
  numbers, other signs or white space, or a possible contraction) with the byte machine's state there, and each
  transition carries the tokens emitted, also corrections when white space or a contraction turns out otherwise.

A text is cut into chunks anywhere outside its special strings.  Every chunk gives a state map, from the state before it to the
state behind it and the tokens emitted, without knowing the state before it: all but its first and last word lies between
places where white space follows anything else, which bring every state to the same one.  So a map is the characters up to
the first such place, on which it depends on the state, and behind it a fixed count and a fixed state.  Maps compose
associatively (``compose``); a text's maps are combined by a scan of pairwise compositions.

Defined results: null and empty texts have 0 tokens; texts of any length are counted whole; repeated rows
stay; an empty table gives an empty result.  Special strings inside a text are one token, which is the
library's default.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import common

LIMIT = 1024
CHUNK_CHARS = 1 << 12
#: Entries a worker keeps of macro transitions and of states; more and that table starts afresh.
MACROS, STATES = 1_000_000, 60_000
#: Transitions over characters that a worker keeps.
STEPS = 300_000

# Unicode White_Space, which the split pattern's \s stands for.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions that the split pattern takes first.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_OTHER, _LETTER, _NUMBER, _SPACE, _BLANK = 0, 1, 2, 3, 4


def character_classes() -> np.ndarray:
    """The class of every code point: letter, number, the space, other white space, or other."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    kinds = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            kinds[a : b + 1] = kind
    kinds[WHITE_SPACE] = _BLANK
    kinds[32] = _SPACE
    return kinds


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file (a rule of the format)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """The transducer of one merge table."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        named = set(self.specials)
        self.bytes_of = {i: raw(s) for s, i in vocab.items() if s not in named}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y = vocab[a], vocab[b]
            self.rank[x, y] = r
            self.merged.setdefault(vocab[a + b], (x, y))
        self.merge_rank = {t: self.rank[p] for t, p in self.merged.items()}
        # the vocabulary as a trie: child of (node, byte), and the token that ends at a node
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        self.grows: set[int] = set()
        for b, token in self.id_of.items():
            node = 0
            for x in b:
                known = self.child.get(node << 8 | x)
                if known is None:
                    known = self.child[node << 8 | x] = len(self.token_at)
                    self.token_at.append(-1)
                    self.grows.add(node)
                node = known
            self.token_at[node] = token
        self.fits: dict[int, bool] = {}
        self.macros = _Macros(self)
        self.reset()

    def reset(self) -> None:
        # a state: (trie node of the text since a start, last token before it, tokens before it less those by now), ...
        self.start = (0, -1, 0)
        self.number = {self.start: 0}
        self.states: list[tuple[int, ...]] = [self.start]
        self.next: list[dict[int, tuple[int, int]]] = [{}]

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens next to each other, rather than merge across them."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            known = self._follows(left, right)
            if len(self.fits) >= MACROS:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _follows(self, left: int, right: int) -> bool:
        # undo the later of both sides' merges until a pair that would have merged first is met
        limit = len(self.rank)
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < limit:
                return False
            p, q = self.merge_rank.get(left, -1), self.merge_rank.get(right, -1)
            if p < 0 and q < 0:
                return True
            if p > q:
                limit, left = p, self.merged[left][1]
            else:
                # of equal merges the one further left goes first, so an equal rank counts as earlier here
                limit, right = q + 1, self.merged[right][0]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens emitted) for one byte; compiled when first met."""
        child, token_at, grows, old = self.child.get, self.token_at, self.grows, self.states[state]
        grown: list[int] = []
        last = count = -1
        for k in range(0, len(old), 3):  # longest first
            node = child(old[k] << 8 | byte)
            if node is not None:
                before, c = old[k + 1], old[k + 2]
                if node in grows:
                    grown += node, before, c
                if last < 0 and (token := token_at[node]) >= 0 and (before < 0 or self.follows(before, token)):
                    last, count = token, c + 1
        grown[2::3] = [c - count for c in grown[2::3]]
        after = (*grown, 0, last, 0)
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
            self.next.append({})
        self.next[state][byte] = number, count
        return number, count

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token: the sum of what its transitions emit."""
        return self.walk(0, word)[1]

    def walk(self, state: int, data: bytes) -> tuple[int, int]:
        """The state behind some bytes, and the tokens that their transitions emit."""
        total = 0
        for b in data:
            known = self.next[state].get(b)
            if known is None:
                known = self.step(state, b)
            state = known[0]
            total += known[1]
        return state, total


class _Macros(dict):
    """Macro transitions: from a pre-token to the tokens it emits between two visits of the start state."""

    def __init__(self, bpe: ByteBPE) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> int:
        made = self.bpe.count(word.encode("utf-8", "surrogatepass"))
        if len(self) >= MACROS:
            self.clear()
        if len(word) <= 64:
            self[word] = made
        return made


class Splitter:
    """Finds pre-tokens and combines chunks' state maps."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bpe, self.kinds = bpe, character_classes()
        self.steps: dict[tuple, tuple[tuple, int]] = {}
        self.special = re.compile("|".join(map(re.escape, bpe.specials))) if bpe.specials else None

    def starts(self, text: str) -> np.ndarray:
        """Positions where a pre-token begins; the text is taken as a whole one."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kind = self.kinds[points]
        blank = kind >= _SPACE
        begin = np.ones(len(kind), dtype=bool)
        before, now = kind[:-1], kind[1:]
        both_blank = blank[:-1] & blank[1:]
        # a run's last blank stands apart when more text follows it
        ends_run = np.zeros(len(kind), dtype=bool)
        ends_run[:-1] = blank[:-1] & ~blank[1:]
        begin[1:] = np.where(both_blank, ends_run[1:], np.where(blank[1:], True, (before != now) & (before != _SPACE)))
        marks = (begin & (points == 39)).nonzero()[0] if 39 in points else ()
        for i in marks:  # contractions, where an apostrophe begins a pre-token
            for c in CONTRACTIONS:
                if text.startswith(c, i):
                    begin[i + 1 : i + len(c)] = False
                    if i + len(c) < len(text) and not blank[i + len(c)]:
                        begin[i + len(c)] = True
                    break
        return begin.nonzero()[0]

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        at = self.starts(text).tolist()
        return sum(map(self.bpe.macros.__getitem__, map(text.__getitem__, map(slice, at, [*at[1:], len(text)]))))

    def step(self, state: tuple, ch: str) -> tuple[tuple, int]:
        """(next state, tokens emitted) for one character of a plain text; compiled when first met.

        States: () outside of any pre-token; (kind, byte state, mark) in a run, where mark is "'" behind an apostrophe that
        began the run, or the letter behind it that may belong to a contraction; (blank kind, byte state of the run, byte
        state without its last character, tokens that this one added, this character).
        """
        known = self.steps.get((state, ch))
        if known is None:
            if len(self.steps) >= STEPS:
                self.steps.clear()
            known = self.steps[state, ch] = self._step(state, ch)
        return known

    def _step(self, state: tuple, ch: str) -> tuple[tuple, int]:
        kind, data, walk = int(self.kinds[ord(ch)]), ch.encode("utf-8", "surrogatepass"), self.bpe.walk
        blank_run = len(state) == 5
        if kind >= _SPACE:
            before = state[1] if blank_run else 0
            after, emitted = walk(before, data)
            return (_BLANK, after, before, emitted, ch), emitted
        emitted, lead = 0, 0
        if blank_run:  # the last blank stands apart: before a word it joins it if it is the space
            emitted = -state[3]
            if state[4] == " ":
                lead, n = walk(0, b" ")
            else:
                _, n = walk(0, state[4].encode("utf-8"))
            emitted += n
            state = (kind, lead, "") if lead else ()
            if lead:
                after, n = walk(lead, data)
                return (kind, after, ""), emitted + n
        if state:
            own, inside, mark = state
            if mark == "'":
                if ch in "stmd":
                    after, n = walk(inside, data)
                    return (), n
                if ch in "rvl":
                    after, n = walk(0, data)
                    return (_LETTER, after, ch), n
            elif mark and mark + ch in ("re", "ve", "ll"):
                plain = walk(0, b"'")[1] + walk(0, mark.encode())[1]
                return (), walk(0, b"'" + mark.encode() + data)[1] - plain
            if own == kind:
                after, n = walk(inside, data)
                return (kind, after, ""), emitted + n
        after, n = walk(0, data)
        return (kind, after, "'" if ch == "'" else ""), emitted + n

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The state behind a plain text, and the tokens emitted on the way."""
        total = 0
        for ch in text:
            state, n = self.step(state, ch)
            total += n
        return state, total

    def chunk(self, text: str) -> tuple:
        """A chunk's state map: (characters that depend on the state before,) or, behind them, (.., tokens, state)."""
        blank = self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")] >= _SPACE
        at = (blank[1:] & ~blank[:-1]).nonzero()[0]
        if not len(at):
            return (text,)
        first, last = int(at[0]) + 1, int(at[-1]) + 1
        state, n = self.run((), text[last:])
        return (text[:first], self.plain(text[first:last]) + n, state)

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two chunks in a row."""
        if len(a) == 1:
            return (a[0] + b[0], *b[1:])
        state, n = self.run(a[2], b[0])
        return (a[0], a[1] + n, state) if len(b) == 1 else (a[0], a[1] + n + b[1], b[2])

    def applied(self, state: tuple, chunk: tuple) -> tuple[tuple, int]:
        """The state behind a chunk and the tokens emitted in it, from the state before."""
        after, n = self.run(state, chunk[0])
        return (after, n) if len(chunk) == 1 else (chunk[2], n + chunk[1])

    def scanned(self, text: str, chunk_chars: int) -> int:
        """Tokens of a text without special strings, by a scan over the maps of its chunks."""
        maps = [self.chunk(text[k : k + chunk_chars]) for k in range(0, len(text), chunk_chars)]
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return self.applied((), maps[0])[1]

    def count(self, text: str | None, chunk_chars: int = CHUNK_CHARS) -> int:
        """Tokens of a whole text; each special string in it is one."""
        if not text:
            return 0
        if len(self.bpe.states) >= STATES:  # between texts, as maps name states by number
            self.bpe.reset()
            self.steps.clear()
        parts = self.special.split(text) if self.special is not None and self.special.search(text) else [text]
        return len(parts) - 1 + sum(self.scanned(p, chunk_chars) for p in parts if p)


_MACHINES: dict[str, Splitter] = {}


def machine(path: str) -> Splitter:
    """The worker's machine for a vocabulary file."""
    if path not in _MACHINES:
        _MACHINES[path] = Splitter(ByteBPE(path))
    return _MACHINES[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(vocabulary or default_vocabulary())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [m.count(x, chunk_chars) for x in texts]
            sizes = [len(x.encode("utf-8", "surrogatepass")) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    common.bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.read(spark, sf_dir, "documents"))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
