"""Operator 1, document fingerprints: MinHash over word shingles.

Shingles of five words are hashed to 64 bits; each of the universal permutations
``h -> a*h + b mod 2**32`` (a odd) is applied to the high halves of all shingles of a text at once in numpy.
The shingle with the smallest value (of several, the one with the smallest low half) is the permutation's pick,
and its 64 bits, mixed anew for each permutation, give the signature: the smallest value itself lies near 0 in
any long text and so says little.

``duplicate_classes`` joins bands of the signature in Spark and verifies the exact Jaccard similarity:

1. Texts with equal shingle sets are one representative.  Bands that only one representative has are dropped by
   their counts before anything else is shipped.
2. Hubs: a representative is compared with those that come first in most of its bands, which joins large
   groups of near copies at HUBS pairs each.
3. Bands whose members then lie in several components are compared in full, all members with all, in blocks
   of bounded size (see ``blocks``), so that no pair that shares a band stays unverified between components.

With BANDS bands of BAND_ROWS values, two sets of similarity 0.8 share a band with a chance of 0.998, of 0.85
and more of 0.9999.

Defined results: a null text counts as empty.  A text without words has the fingerprint of the empty
set, which is as like as 1 to itself and 0 to any other, and is a class of its own.  Repeated rows stay, one
result each.  Rows whose doc_id is null come last in the descending order, rows of one doc_id go by a hash of their
texts; a class is named by the smallest doc_id of its documents, null if none has one.  An empty table gives an
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.llm import blocks, common
from loomspark.llm.shingles import WORDS_PER_SHINGLE, mix64, shingle_hashes, shingle_set, word_hashes, words_at

PERMUTATIONS = 128
BAND_ROWS = 6
BANDS = PERMUTATIONS // BAND_ROWS
PERCENT = 80
HUBS = 2
#: A band's list of up to this length is compared as pairs, a longer one in blocks.
SHORT_LIST = 8
_BLOCK = 2048
_RNG = np.random.default_rng(7919)
_A = (_RNG.integers(0, 2**32, size=PERMUTATIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 2**32, size=PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
_UNDO = np.array([pow(int(a), -1, 2**32) for a in _A[:, 0]], dtype=np.uint32)
_SALT = _RNG.integers(0, 2**64, size=PERMUTATIONS, dtype=np.uint64)
_BAND = _RNG.integers(0, 2**63, size=(PERMUTATIONS,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least(whole: np.ndarray) -> np.ndarray:
    """Each permutation's smallest value over shingle hashes."""
    best = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    h = (whole >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), _BLOCK):
        values = _A * h[None, at : at + _BLOCK]
        values += _B
        np.minimum(best, values.min(axis=1), out=best)
    return best


def _signed(whole: np.ndarray, best: np.ndarray) -> np.ndarray:
    """32 mixed bits of each permutation's pick, from all shingle hashes and the smallest values; all ones for the empty set."""
    if not len(whole):
        return best
    h = (whole >> np.uint64(32)).astype(np.uint32)
    return (mix64(_picks(whole, h, _UNDO * (best - _B[:, 0])) ^ _SALT) >> np.uint64(32)).astype(np.uint32)


def signature_of(whole: np.ndarray) -> np.ndarray:
    return _signed(whole, _least(whole))


def signature(text: str | None, n: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """The signature of the shingles of a whole text."""
    return signature_of(shingle_hashes(word_hashes(text), n))


class Signed:
    """A text with its words, shingles and signature, from which those of its edited text follow."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.text = data.decode("utf-8", "surrogatepass")
        self.words, self.ends = words_at(data)
        self.shingles = shingle_hashes(self.words)
        self.least = _least(self.shingles)
        self.fingerprint = fingerprint(_signed(self.shingles, self.least))

    def edited(self, following: str) -> tuple[bytes, bytes]:
        """The edited text in UTF-8 and its fingerprint: words and minima before the cut are taken over."""
        k = len(self.text) // 3
        kept = self.text[: len(self.text) - k].encode("utf-8", "surrogatepass")
        edited = kept + following[:k].encode("utf-8", "surrogatepass")
        if edited == self.data:
            return edited, self.fingerprint
        same = int(np.searchsorted(self.ends, len(kept)))  # words that end before the cut
        start = int(self.ends[same - 1]) if same else 0
        words = np.concatenate([self.words[:same], words_at(edited[start:])[0]])
        shingles = shingle_hashes(words)
        whole = max(0, same - WORDS_PER_SHINGLE + 1) if len(words) >= WORDS_PER_SHINGLE else 0
        before = min(whole, len(self.shingles), len(shingles))
        # minima of what both share: of own shingles, less those behind the cut
        least = np.minimum(_least(self.shingles[:before]), _least(shingles[before:]))
        return edited, fingerprint(_signed(shingles, least))


def _picks(whole: np.ndarray, h: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The smallest hash of whole for each of the picked high halves; all of them occur in h."""
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[picked & np.uint32(0xFFFF)] = True
    few = np.sort(whole[maybe[h & np.uint32(0xFFFF)]])
    return few[np.searchsorted(few, picked.astype(np.uint64) << np.uint64(32))]


def fingerprint(sig: np.ndarray) -> bytes:
    """The high 16 bits of each value of the signature."""
    return (sig >> np.uint32(16)).astype("<u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity: the share of equal values, less what 16 bits agree on by chance."""
    x, y = np.frombuffer(a, dtype="<u2"), np.frombuffer(b, dtype="<u2")
    empty = bool((x == 0xFFFF).all()), bool((y == 0xFFFF).all())
    if any(empty):
        return float(all(empty))
    chance = 1 / 65536
    return max(0.0, (float((x == y).mean()) - chance) / (1 - chance))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, and the fingerprint of its text as base64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            made = [base64.b64encode(fingerprint(signature(x))).decode() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, type=pa.string())], names=[*batch.schema.names, "fingerprint"])

    common.bound_batches(docs.sparkSession)
    kept = docs.drop("fingerprint")
    return kept.mapInArrow(run, kept.schema.add("fingerprint", "string"))


def bands_of(sig: np.ndarray, band_rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit hash of each band of a signature; bands in different places have different hashes."""
    n = PERMUTATIONS // band_rows
    weighted = (sig[: n * band_rows].astype(np.uint64) * _BAND[: n * band_rows]).reshape(n, band_rows).sum(axis=1, dtype=np.uint64)
    return mix64(weighted + np.arange(n, dtype=np.uint64) * _BAND[0]).view(np.int64)


def set_key(s: np.ndarray) -> bytes | None:
    """The name of a shingle set; none for the empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _place(doc_id: int | None, h: int) -> tuple:
    """Sorts as the descending order of ids does: nulls last, rows of one id by the hash of their texts."""
    return (1, 0, h) if doc_id is None else (0, -doc_id, h)


def _borders(quantiles: list[int], nulls: float, pieces: int) -> list[tuple]:
    """Places that cut the order into ranges; an id (or null) that holds several quantiles is itself cut by hash."""
    borders = []
    split = lambda k: [-(1 << 63) + (j << 64) // k for j in range(k)]
    for value, often in Counter(quantiles).items():
        borders += [(0, -value, h) for h in split(often)]
        if often > 1:
            borders.append((0, 1 - value, -(1 << 63)))
    borders += [(1, 0, h) for h in split(max(1, round(nulls * pieces)))]
    return sorted(set(borders))


_DEALT = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("text", pa.binary()), ("at", pa.int32()), ("tail", pa.int32())])
_EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("key", pa.binary())])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text and its edited text (see op1): fingerprints, likenesses, and the key of the text's shingle set.

    The order of the ids is cut into ranges at approximate quantiles, each range is a small share of
    the rows and handled in order by one task; the first row of a range is also dealt to the range before
    it, which is all that crosses a border.  Only as many borders as there are ranges pass the driver.  Texts are
    shuffled once, compressed.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = common.partitions(spark)
    pieces = 4 * n
    shape = base.agg(F.percentile_approx("doc_id", [k / pieces for k in range(1, pieces)], 100 * pieces).alias("q"), F.avg(F.col("doc_id").isNull().cast("int")).alias("nulls")).first()
    borders = _borders(shape["q"] or [], shape["nulls"] or 0.0, pieces)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect.bisect_right(borders, _place(i, h)) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=["doc_id", "h", "at"])

    # heads: the row that stands first in its range
    first = F.min(F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "h")).alias("first")
    found = base.select("doc_id", "h").mapInArrow(ranged, "doc_id long, h long, at int").groupBy("at").agg(first).collect()
    heads = {r["at"]: _place(None if r["first"][0] else -r["first"][1], r["first"][2]) for r in found}
    order = sorted(heads)
    before = {at: order[k - 1] for k, at in enumerate(order)}  # the first range's head goes to the last

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place, packed = _place(doc_id, h), common.pack_text(text)
                at = bisect.bisect_right(borders, place)
                rows.append((doc_id, h, packed, at, 0))
                if heads[at] == place:
                    rows.append((doc_id, h, packed, before[at], 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), _DEALT, strict=True)], schema=_DEALT) if rows else pa.RecordBatch.from_pylist([], schema=_DEALT)

    dealt = base.mapInArrow(deal, "doc_id long, h long, text binary, at int, tail int").repartition(n, "at").sortWithinPartitions("at", "tail", F.col("doc_id").desc_nulls_last(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the one after it
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, packed, tail in zip(*(batch.column(k).to_pylist() for k in (0, 2, 4)), strict=True):
                own = Signed(common.unpack_bytes(packed))
                if held is not None:
                    mine, last = held
                    edited, other = last.edited(own.text)
                    first, key = last.fingerprint, set_key(np.unique(last.shingles))
                    rows.append((mine, len(last.text), hashlib.sha256(edited).hexdigest(), base64.b64encode(first).decode(), base64.b64encode(other).decode(), likeness(first, other), likeness(first, own.fingerprint), key))
                held = None if tail else (doc_id, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), _EDITED, strict=True)], schema=_EDITED)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, key binary")


def _sets_of(packed: list[bytes]) -> list[np.ndarray]:
    return [shingle_set(common.unpack_text(x)) for x in packed]


def duplicate_classes(docs: DataFrame, percent: int = PERCENT, band_rows: int = BAND_ROWS) -> DataFrame:
    """(key, class_id): the class of each shingle set that several documents have or that links with another."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(part: dict) -> dict:
        shingles = [shingle_hashes(word_hashes(x)) for x in part["text"]]
        sets = list(map(np.unique, shingles))
        made = [bands_of(signature_of(x), band_rows).tolist() if len(x) else [] for x in shingles]
        return {"doc_id": part["doc_id"], "h": part["h"], "n": list(map(len, sets)), "key": list(map(set_key, sets)), "bands": made}

    signed = common.map_batches(base, sign, "doc_id long, h long, n long, key binary, bands array<bigint>", schema).filter("key is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("at")
    reps = common.checkpoint(signed.groupBy("key").agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    often = common.checkpoint(reps.select(F.explode("bands").alias("token")).groupBy("token").count().filter("count > 1").select("token"))
    n_often = often.count()
    shared = common.checkpoint(reps.select(F.col("key").alias("id"), "n", F.explode("bands").alias("token")).join(blocks.small(often, n_often), "token", "left_semi"))
    hubs = shared.groupBy("token").agg(F.min("id").alias("hub"))
    near = shared.join(blocks.small(hubs, n_often), "token").filter("id <> hub").groupBy("hub", "id").agg(F.count("*").alias("lists"))
    best = W.partitionBy("id").orderBy(F.desc("lists"), "hub")
    pairs = common.checkpoint(near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= HUBS).select(F.col("hub").alias("src"), F.col("id").alias("dst")))

    def texts(ids: DataFrame) -> DataFrame:
        """(id, payload): the compressed text of each set in ids (id)."""
        wanted = common.checkpoint(reps.join(ids, reps["key"] == ids["id"], "left_semi").select("key", "at.doc_id", "at.h"))
        rows = base.alias("b").join(blocks.small(wanted, wanted.count()).alias("w"), F.expr("b.doc_id <=> w.doc_id and b.h = w.h")).select(F.col("w.key").alias("id"), "b.text")
        types = pa.schema([("id", pa.binary()), ("payload", pa.binary())])
        packed = common.map_batches(rows, lambda part: {"id": part["id"], "payload": list(map(common.pack_text, part["text"]))}, "id binary, payload binary", types)
        return packed.groupBy("id").agg(F.min("payload").alias("payload"))

    links = common.checkpoint(blocks.verified(pairs, texts(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()), _sets_of, percent))
    labels = common.components(links)
    rest = shared.join(labels, "id", "left").select("token", "id", "n", F.coalesce("component", "id").alias("component"))
    lists = rest.groupBy("token").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    lists = common.checkpoint(lists.select("token", "members"))
    rest = common.checkpoint(rest.join(blocks.small(lists, lists.count()), "token"))
    short = rest.filter(F.col("members") <= SHORT_LIST)
    a, b = short.select("token", F.col("id").alias("src"), F.col("n").alias("sn"), F.col("component").alias("sc")), short.select("token", F.col("id").alias("dst"), F.col("n").alias("dn"), F.col("component").alias("dc"))
    pairs = a.join(b, "token").filter(f"src < dst and sc <> dc and 100 * least(sn, dn) >= {percent} * greatest(sn, dn)").select("src", "dst").distinct()
    long_ = rest.filter(F.col("members") > SHORT_LIST).select("token", "id", "n", "component")
    payload = texts(rest.select("id").distinct())
    late = common.checkpoint(blocks.verified(pairs, payload, _sets_of, percent).union(blocks.block_links(long_, payload, _sets_of, percent)))
    labels = common.components(links.union(late))
    named = reps.join(labels, reps["key"] == labels["id"], "left").select("key", "copies", "at.doc_id", F.coalesce("component", "key").alias("component"), F.col("component").isNotNull().alias("linked"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return named.filter("linked or copies > 1").join(names, "component").select("key", "class_id")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, class_id): classes of documents whose shingle sets are linked at the threshold."""
    types = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])
    keyed = common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda part: {"doc_id": part["doc_id"], "key": [set_key(shingle_set(x)) for x in part["text"]]}, "doc_id long, key binary", types)
    return with_classes(keyed, duplicate_classes(docs, percent, band_rows)).select("doc_id", "class_id")


def with_classes(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """keyed (doc_id, key, ...) with class_id; what no class holds is its own."""
    classes = common.checkpoint(classes.select(F.col("key").alias("_key"), "class_id"))
    joined = keyed.join(blocks.small(classes, classes.count()), F.col("key") == F.col("_key"), "left")
    return joined.withColumn("class_id", F.when(F.col("_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))).drop("_key")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and class_id, the document's class of near duplicates."""
    docs = common.read(spark, sf_dir, "documents")
    classes = duplicate_classes(docs)
    return with_classes(edited_fingerprints(docs), classes).drop("key")


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLES: dict[str, str] = {}
