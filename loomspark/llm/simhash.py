"""Operator 11, SimHash near-duplicates through segment popcounts.

A text's fingerprint has a bit set where over half of its shingles' hashes have it.  Two fingerprints link when they
differ in at most 2 bits.  The join is exact and runs on distinct fingerprints:

1. Embedding: a fingerprint is cut into segments and mapped to the vector of their bit counts.  A bit that
   differs moves one count by one, so the Manhattan distance of two vectors is at most the number of bits
   in which the fingerprints differ.
2. Grid range join: the grid's cells are the vectors themselves.  Each fingerprint is put into its own cell and into those
   at distance 1; vectors at distance 2 or less have a cell in common, as the grid has a point half way.  Cells are counted
   with partial sums, and only those with several members go on.
3. Verification: the members of a short cell are compared as pairs, exactly.  In a longer one they are dealt
   once more, by the fingerprints that lie in the cell and one bit away at most: two members that share one of these differ in at most 2
   bits, and two that differ so share one in some cell.  So each is linked to the smallest member it shares one with, and no
   cell's pairs are written down.

Defined results: null, empty and blank texts have the fingerprint zero, which links like any other; each row is a document of
its own (equal ids are not linked by that); a row without an id counts as a way between others but never as the
smallest id, and has a null component where no linked row has an id; texts of any length are taken whole; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import common
from loomspark.llm.blocks import small

WORDS_PER_SHINGLE, SEED = 3, 42
#: Bytes of a text whose words are held at once.
SEGMENT_BYTES = 1 << 20
#: Shingles whose hashes are counted at once.
BLOCK = 1 << 14
#: Members up to which a cell is compared as pairs.
SHORT_CELL = 24
#: Up to so many fingerprints, segments have four bits; above, two: more cells to write, fewer to share by chance.
FINE_FROM = 1 << 26
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in parts of about SEGMENT_BYTES, lower case for A-Z."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + SEGMENT_BYTES)
        end = cut.start() if cut else len(data)
        yield data[at:end].lower().split()
        at = end


def _shingles(data: bytes, n: int) -> Iterator[bytes]:
    """All n-word shingles in order, repeats included; fewer words give one shingle, no words none."""
    kept: list[bytes] = []
    few = True
    for words in _words(data):
        kept += words
        if len(kept) >= n:
            few = False
            yield from map(b" ".join, zip(*(kept[k:] for k in range(n)), strict=False))
            kept = kept[len(kept) - n + 1 :]
    if few and kept:
        yield b" ".join(kept)


def fingerprint(data: bytes | None, n: int = WORDS_PER_SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text in UTF-8."""
    from xxhash import xxh64_intdigest

    hashes = map(xxh64_intdigest, _shingles(data or b"", n), repeat(seed))
    ones, total = np.zeros(64, dtype=np.int64), 0
    while len(block := np.fromiter(islice(hashes, BLOCK), dtype="<u8")):
        ones += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        total += len(block)
    return sum(1 << k for k in (2 * ones > total).nonzero()[0].tolist())


def fingerprints(docs: DataFrame, n_words: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed 64-bit integer."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(part: dict) -> dict:
        made = np.array([fingerprint(x, n_words) for x in part["text"]], dtype=np.uint64)
        return {"doc_id": part["doc_id"], "fp": made.view(np.int64)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return common.map_batches(rows, run, "doc_id long, fp long", schema)


def segment_bits(n_fingerprints: int) -> int:
    return 4 if n_fingerprints <= FINE_FROM else 2


def popcounts(fp: Column, width: int) -> Column:
    """The bit counts of a fingerprint's segments of 2 or 4 bits, each in the place of its segment."""
    every = lambda bits: F.lit(int(bits * (64 // len(bits)), 2))
    low, high = fp.bitwiseAND(every("01")), F.shiftrightunsigned(fp, 1).bitwiseAND(every("01"))
    pairs = F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))
    if width == 2:
        return pairs
    return pairs.bitwiseAND(every("0011")) + F.shiftrightunsigned(pairs, 2).bitwiseAND(every("0011"))


def near_cells(cell: Column, width: int) -> Column:
    """A cell and those at Manhattan distance 1."""
    out = [cell]
    for at in range(0, 64, width):
        mask = ((1 << width) - 1) << at
        own, rest = F.shiftrightunsigned(cell, at).bitwiseAND(F.lit((1 << width) - 1)), cell.bitwiseAND(_signed(~mask & (1 << 64) - 1))
        put = lambda count: rest.bitwiseOR(F.shiftleft(count, at))  # noqa: B023, E731
        out += [F.when(own < width, put(own + 1)), F.when(own > 0, put(own - 1))]
    return F.array_compact(F.array(*out))


def _signed(bits: int) -> Column:
    """A literal of 64 bits."""
    return F.lit(bits - (1 << 64) if bits >> 63 else bits)


def near_links(prints: DataFrame, bits: int | None = None) -> DataFrame:
    """Links (src, dst) between distinct fingerprints (fp) that differ in at most 2 bits; all others follow through them."""
    width = bits or segment_bits(prints.count())
    cells = prints.select("fp", F.explode(near_cells(popcounts(F.col("fp"), width), width)).alias("cell"))
    shared = common.stored(cells.groupBy("cell").agg(F.count("*").alias("members")).filter("members > 1"))
    met = common.stored(cells.join(small(shared, shared.count()), "cell"))
    short, long_ = met.filter(F.col("members") <= SHORT_CELL), met.filter(F.col("members") > SHORT_CELL)
    a, b = short.select("cell", F.col("fp").alias("src")), short.select("cell", F.col("fp").alias("dst"))
    pairs = a.join(b, "cell").filter("src < dst and bit_count(src ^ dst) <= 2").select("src", "dst")
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(_signed(1 << k)) for k in range(64)))
    inside = F.filter(flips, lambda x: popcounts(x, width) == F.col("cell"))
    keyed = long_.select("fp", F.explode(inside).alias("key"))
    heads = keyed.groupBy("key").agg(F.min("fp").alias("src"), F.max("fp").alias("last")).filter("src < last").select("key", "src")
    stars = keyed.join(heads, "key").filter("src < fp").select("src", F.col("fp").alias("dst"))
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame, n_words: int = WORDS_PER_SHINGLE, bits: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: 16 hex digits, and the smallest doc_id reachable over links."""
    prints = common.stored(fingerprints(docs, n_words))
    distinct = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    labels = common.components(near_links(distinct.select("fp"), bits))
    linked = distinct.join(labels.withColumnRenamed("id", "fp"), "fp")
    heads = linked.groupBy("component").agg(F.min("rep").alias("head"))
    joined = linked.join(heads, "component").select("fp", F.col("head").alias("component_id"))
    alone = distinct.join(labels.withColumnRenamed("id", "fp"), "fp", "left_anti").filter("n > 1").select("fp", F.col("rep").alias("component_id"))
    known = common.stored(joined.union(alone))
    out = prints.join(small(known, known.count()), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(common.read(spark, sf_dir, "documents"))


QUERIES = {"op11_simhash": op11_simhash}
ORACLES: dict[str, str] = {}
