"""Operator 5, packing by the online sum-of-squares rule.

Documents become token ids (tokenizers, plus an end id) and are placed one after another into windows of
2048 ids.  A level array N holds how many open windows are filled to each level; a piece goes to the level
(or to a new window) that makes the sum of N[h]**2 smallest, which keeps the levels varied and so leaves
few gaps.  Whole windows of a longer document are sequences of their own.

Each input partition is packed by its own task in one pass and without a shuffle; sequence ids carry the
partition's number.  At a partition's end, and whenever OPEN_WINDOWS are open, windows are topped up from each
other: pieces of the emptiest are cut to fill the fullest.  At the end the last remainder becomes sequences whose
lengths are powers of two.  No sequence has padding.  Ids held in memory are those of open windows only.

Defined results: null and empty texts are the end id alone; very long texts are cut, every id in exactly
one piece; repeated rows are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import common
from loomspark.llm.token_counts import byte_symbols

WINDOW = 2048
END_ID = 1
#: Chunks, and parts of chunks, whose ids a worker remembers; bounds memory, never the result.
MEMO_CHUNKS = 250_000
#: Chunks and parts of up to this length are remembered.
MEMO_LENGTH = 64
#: Windows open at most (16 MB of ids in lists of pieces); then half of them are closed.
OPEN_WINDOWS = 2048


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The text treatment for which the rules below hold; with any other the library handles whole texts.
RULED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: What a chunk may hold to be cut by rule: printable ASCII but the apostrophe, and the composed letters of Latin-1.
_PLAIN = re.compile(r"[!-&(-~\u00e0-\u00f6\u00f8-\u00ff]+")
#: Pre-tokens of such a chunk in lower case: runs of letters, single digits, runs of anything else.
_PARTS = re.compile(r"[a-z\u00e0-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00e0-\u00f6\u00f8-\u00ff]+")


class Ids(dict):
    """Token ids of texts, and a memo of the ids of chunks.

    The vocabulary drops white space and never joins across it, so that the ids of a text are those of its
    white-space separated chunks in a row.  A chunk of plain letters, digits and signs is cut into pre-tokens
    here and each is looked up or handed to the library's merge model; any other goes through the whole tokenizer.
    This holds for the treatment of text in RULED; for a vocabulary with another one the library takes each text whole.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        # special strings with white space inside would be cut by it
        self.ruled = all(spec[k] == v for k, v in RULED.items()) and not any(set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in spec["added_tokens"])
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.symbols = {b: c for c, b in byte_symbols().items()}

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        low = text.lower()
        if _PLAIN.fullmatch(low) and "<|" not in text and len(low) == len(text):
            ids = b"".join([self.parts.get(p) or self._part(p) for p in _PARTS.findall(low)])
        else:
            ids = _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(chunk) <= MEMO_LENGTH:
            if len(self) >= MEMO_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids

    def _part(self, part: str) -> bytes:
        units = part if part.isascii() else "".join(map(self.symbols.__getitem__, part.encode("utf-8")))
        ids = _bytes([t.id for t in self.model.tokenize(units)])
        if len(part) <= MEMO_LENGTH:
            if len(self.parts) >= MEMO_CHUNKS:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if not text:
            return b""
        if not self.ruled:
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, text.encode("utf-8").split()))


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Packer:
    """Places pieces into windows; yields rows (doc_id, start, length, crc, doc_tokens, sequence_id, offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW) -> None:
        self.window, self.next = window, first_sequence
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]  # windows by level, each a list of pieces
        self.n_open = 0

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        rows, offset, number = [], 0, self.next
        self.next += 1
        for doc_id, start, ids, total in pieces:
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, number, offset))
            offset += len(ids) // 4
        return rows

    def level_for(self, size: int) -> int:
        """The level that minimises the sum of squares when a piece of this size goes there; 0 is a new window."""
        n, top = self.levels, self.window - size
        change = 2 * (n[size : self.window + 1] - n[: top + 1]) + 2
        change[top] -= 1  # a full window leaves the array
        change[n[: top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] + 1
        return top - int(np.argmin(change[::-1]))  # ties go to the fullest

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        """Place a document; returns the rows of sequences that are now full."""
        rows, total, width = [], len(ids) // 4, 4 * self.window
        cut = len(ids) - len(ids) % width
        for at in range(0, cut, width):
            rows += self._sequence([(doc_id, at // 4, ids[at : at + width], total)])
        size = total - cut // 4
        if size:
            level = self.level_for(size)
            pieces = self.open[level].pop() if level else []
            if level:
                self._count(level, -1)
            pieces.append((doc_id, cut // 4, ids[cut:], total))
            if level + size == self.window:
                rows += self._sequence(pieces)
            else:
                self._count(level + size, 1)
                self.open[level + size].append(pieces)
            if self.n_open > OPEN_WINDOWS:
                rows += self._top_up(OPEN_WINDOWS // 2)[0]
        return rows

    def _count(self, level: int, change: int) -> None:
        self.levels[level] += change
        self.n_open += change

    def _top_up(self, keep: int) -> tuple[list[tuple], list[tuple[int, list[tuple]]]]:
        """Fill the fullest open windows from the emptiest until at most `keep` are open (1 at least); rows of the sequences made, and what is left."""
        left = [(level, w) for level in range(self.window - 1, 0, -1) for w in self.open[level]]
        rows: list[tuple] = []
        i, j = 0, len(left) - 1
        while i < j and j - i + 1 > keep:
            level, pieces = left[i]
            if level & (level - 1) == 0:  # a power of two has no padding
                rows += self._sequence(pieces)
                i += 1
                continue
            gap = self.window - level
            have, donor = left[j]
            doc_id, start, ids, total = donor.pop()
            take = min(gap, len(ids) // 4)
            pieces.append((doc_id, start, ids[: 4 * take], total))
            if take < len(ids) // 4:
                donor.append((doc_id, start + take, ids[4 * take :], total))
            left[i], left[j] = (level + take, pieces), (have - take, donor)
            if take == gap:
                rows += self._sequence(pieces)
                i += 1
            if have == take:
                j -= 1
        left = left[i : j + 1]
        self.levels[:], self.open, self.n_open = 0, [[] for _ in range(self.window)], 0
        for level, pieces in left:
            self._count(level, 1)
            self.open[level].append(pieces)
        return rows, left

    def close(self) -> list[tuple]:
        """Rows of all that is left: windows topped up from each other, the last one in powers of two."""
        rows, left = self._top_up(1)
        if left:
            ((level, pieces),) = left
            for bit in range(level.bit_length() - 1, -1, -1):
                size, part = 1 << bit, []
                if not level & size:
                    continue
                while size:
                    doc_id, start, ids, total = pieces.pop(0)
                    take = min(size, len(ids) // 4)
                    part.append((doc_id, start, ids[: 4 * take], total))
                    if take < len(ids) // 4:
                        pieces.insert(0, (doc_id, start + take, ids[4 * take :], total))
                    size -= take
                rows += self._sequence(part)
        return rows


_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = Ids(vocabulary or default_vocabulary())
        packer = Packer(TaskContext.get().partitionId() << 32, window)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows += packer.add(doc_id, ids_of.of(text) + end)
                if rows:
                    yield batch_of(rows)
        if rows := packer.close():
            yield batch_of(rows)

    common.bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.giving_back(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
