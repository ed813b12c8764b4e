"""Operator 13, ranked lexical search by pipelined term partitioning.

Documents are indexed in shards of bounded size: one row for each term of a shard, with the documents that hold it.  The terms
that items ask for are partitioned among owners by weight, the rarest first.  Items travel in bundles: for each shard a
bundle carries sparse accumulators (item, document, score so far) from owner to owner.  A stage is a cogroup of the
bundles with the owner's postings by (shard, bundle); it adds integer contributions and sends the bundle on.

Accumulators that cannot reach an item's k best are left behind: after a stage the k-th best score so far over all shards is a
score that the result certainly reaches, and a document whose score and all that later owners can add stay below
it is not in the result.  The last stage gives each shard's k best of an item, from which the k best are selected.

Contributions are those of a term with weight w = floor(1000 ln((2N + 2) / (2 df + 1))) in a document with tf occurrences
and m = 50 + 50 n N div L: w ((10**9 tf) div (1000 tf + 20 m)).  Terms are compared by 64-bit hashes.

Defined results: null, empty and term-free texts are in no result and not in N; each row of documents is a document of its
own, one without an id comes last among equal scores; rows that share an item_id are one item with the terms of all, rows
without an item_id take no part; items without terms have no rows; texts of any length are taken whole; empty tables
give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.llm import common
from loomspark.llm.blocks import small

K = 50
#: Owners of terms, and so stages.
OWNERS = 4
#: Documents in a shard at most (numbered in 16 bits), and postings from which it is closed.
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 21
#: Items in a bundle, about; with a shard's documents this bounds a stage's accumulators.
BUNDLE_ITEMS = 128
#: Bytes of a text whose terms are held at once; hashes of terms that a worker remembers.
SEGMENT_BYTES, MEMO = 1 << 20, 1_000_000
#: No term adds more than its weight times this.
MOST = 999_999
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


class _Hashes(dict):
    """A term's hash, signed."""

    def __missing__(self, term: bytes) -> int:
        from xxhash import xxh64_intdigest

        made = int(np.uint64(xxh64_intdigest(term)).astype(np.int64))
        if len(self) >= MEMO:
            self.clear()
        self[term] = made
        return made


def term_counts(data: bytes | None, hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a whole text's distinct terms, and how often each occurs."""
    parts, at = [], 0
    data = data or b""
    while at < len(data):
        cut = _BREAK.search(data, at + SEGMENT_BYTES)
        end = cut.start() if cut else len(data)
        found = _TERM.findall(data[at:end].lower())
        parts.append(np.unique(np.fromiter(map(hashes.__getitem__, found), np.int64, len(found)), return_counts=True))
        at = end
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    terms, back = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    counts = np.zeros(len(terms), np.int64)
    np.add.at(counts, back, np.concatenate([c for _, c in parts]))
    return terms, counts


def _bytes_of(a: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values: the array's bytes from each start to the next."""
    offsets = (np.append(starts, len(a)) * a.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(a.tobytes())])


_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.int64()), ("df", pa.int64()), ("total", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary())])


def index_shards(docs: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(shard, term, df, total, docs, counts): a row for each term of a shard, and one with a null term for the shard itself.

    A term's row holds the numbers of its documents in the shard (16 bits each) and its counts there (32 bits); a shard's own
    row the ids of its documents (64 bits, then a byte each for whether there is one), their lengths (32 bits), how many have terms, and all their terms' number.
    """
    if not 0 < shard_docs <= 1 << 16:
        raise ValueError("a shard holds 1 to 65,536 documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, shard = _Hashes(), TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                found.append(term_counts(text.as_py(), hashes))
                held += len(found[-1][0])
                if len(ids) == shard_docs or held >= SHARD_POSTINGS:
                    yield _shard_rows(shard, ids, found)
                    ids, found, held, shard = [], [], 0, shard + 1
        if ids:
            yield _shard_rows(shard, ids, found)

    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "shard long, term long, df long, total long, docs binary, counts binary")


def _shard_rows(shard: int, ids: list[int | None], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    lengths = np.array([c.sum() for _, c in found], dtype=np.uint32)
    known = np.array([i is not None for i in ids], dtype=np.uint8)
    own = np.array([i or 0 for i in ids], dtype=np.int64).tobytes() + known.tobytes()
    terms, counts = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found]).astype(np.uint32)
    number = np.repeat(np.arange(len(found), dtype=np.uint16), [len(t) for t, _ in found])
    order = np.argsort(terms, kind="stable")
    terms, counts, number = terms[order], counts[order], number[order]
    starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.empty(0, np.int64)
    df = np.diff(starts, append=len(terms))
    n = len(starts)
    rows = pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(terms[starts]), pa.array(df), pa.array(np.zeros(n, np.int64)), _bytes_of(number, starts), _bytes_of(counts, starts)], schema=_INDEX)
    itself = pa.RecordBatch.from_pylist([{"shard": shard, "df": int((lengths > 0).sum()), "total": int(lengths.sum()), "docs": own, "counts": lengths.tobytes()}], schema=_INDEX)
    return pa.Table.from_batches([rows, itself]).combine_chunks().to_batches()[0]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    hashes = _Hashes()

    def run(part: dict) -> dict:
        found = [term_counts(x, hashes)[0] for x in part["text"]]
        return {"item_id": np.repeat(np.array(part["item_id"], dtype=np.int64), [len(t) for t in found]), "term": np.concatenate(found)}

    rows = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return common.map_batches(rows, run, "item_id long, term long", pa.schema([("item_id", pa.int64()), ("term", pa.int64())])).distinct()


@dataclass(frozen=True)
class Corpus:
    """What contributions depend on: the number of documents with terms, and of all their terms."""

    n: int
    total: int

    def parts(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The factor beside a term's weight in documents with so many occurrences and terms."""
        m = 50 + (50 * lengths * self.n) // self.total
        return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def _sparse(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Accumulators from bytes: items' and documents' numbers, scores."""
    n = len(raw) // 12
    return np.frombuffer(raw, np.uint16, n), np.frombuffer(raw, np.uint16, n, 2 * n), np.frombuffer(raw, np.int64, n, 4 * n)


def _raw(slots: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> bytes:
    return slots.astype(np.uint16).tobytes() + docs.astype(np.uint16).tobytes() + scores.astype(np.int64).tobytes()


def _accumulated(row: dict, posts: pa.Table, corpus: Corpus) -> np.ndarray:
    """Scores (items x documents) of a bundle in a shard behind a stage."""
    lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
    scores = np.zeros((row["items_n"], len(lengths)), dtype=np.int64)
    slots, docs, so_far = _sparse(row["acc"])
    scores[slots, docs] = so_far
    for number, counts, asks in zip(posts.column("docs"), posts.column("counts"), posts.column("asks"), strict=True):
        at = np.frombuffer(number.as_buffer(), np.uint16)
        part = corpus.parts(np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64), lengths[at])
        for ask in asks.as_py():
            scores[ask["slot"], at] += ask["w"] * part
    return scores


_BUNDLE = "shard long, bundle int, items_n int, items binary, rest binary, ids binary, lengths binary, acc binary"


def _stage(bundles: DataFrame, posts: DataFrame, corpus: Corpus, owner: int, k: int) -> DataFrame:
    """The bundles behind an owner, with each item's k best scores in the shard (tops)."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        scores = _accumulated(row, right, corpus)
        rest = np.frombuffer(row["rest"], np.int64).reshape(row["items_n"], -1)[:, owner]
        if scores.shape[1] > k:
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        else:
            least = np.zeros(len(scores), np.int64)
        keep = (scores > 0) & (scores + rest[:, None] >= least[:, None])
        slots, docs = np.nonzero(keep)
        best, at = np.nonzero((scores > 0) & (scores >= least[:, None]))
        row["acc"] = _raw(slots, docs, scores[slots, docs])
        row["tops"] = _raw(best, at, scores[best, at])
        return pa.Table.from_pylist([row], schema=_BUNDLES.append(pa.field("tops", pa.binary())))

    return bundles.groupBy("shard", "bundle").cogroup(posts.groupBy("shard", "bundle")).applyInArrow(add, _BUNDLE + ", tops binary")


_BUNDLES = pa.schema([("shard", pa.int64()), ("bundle", pa.int32()), ("items_n", pa.int32()), *((c, pa.binary()) for c in ("items", "rest", "ids", "lengths", "acc"))])


def _least(bundles: DataFrame, k: int) -> DataFrame:
    """(bundle, least): for each item of a bundle (slot, score) with k scores over all shards, the k-th best so far."""
    schema = pa.schema([("bundle", pa.int32()), ("slot", pa.int32()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, raw in zip(batch.column(0), batch.column(1), strict=True):
                slots, _, scores = _sparse(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), bundle.as_py(), np.int32)), pa.array(slots.astype(np.int32)), pa.array(scores)], schema=schema)

    tops = bundles.select("bundle", "tops").mapInArrow(run, "bundle int, slot int, score long")
    ranked = tops.withColumn("r", F.row_number().over(W.partitionBy("bundle", "slot").orderBy(F.desc("score")))).filter(F.col("r") <= k)
    bounds = ranked.groupBy("bundle", "slot").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == k)
    return bounds.groupBy("bundle").agg(F.collect_list(F.struct("slot", "score")).alias("least"))  # as many as a bundle has items


def _pruned(bundles: DataFrame, least: DataFrame, owner: int) -> DataFrame:
    """The bundles without accumulators that cannot reach their item's k best, before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bound = np.zeros(row["items_n"], np.int64)
                for x in row.pop("least") or ():
                    bound[x["slot"]] = x["score"]
                slots, docs, scores = _sparse(row["acc"])
                rest = np.frombuffer(row["rest"], np.int64).reshape(row["items_n"], -1)[:, owner]
                keep = scores + rest[slots] >= bound[slots]
                row["acc"] = _raw(slots[keep], docs[keep], scores[keep])
                yield pa.RecordBatch.from_pylist([row], schema=_BUNDLES)

    return bundles.drop("tops").join(F.broadcast(least) if least.count() <= 1000 else least, "bundle", "left").select(*_BUNDLES.names, "least").mapInArrow(run, _BUNDLE)


def _last(bundles: DataFrame, posts: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    """(item_id, doc_id, score): each shard's k best of each item behind the last owner."""
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def select(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        scores = _accumulated(row, right, corpus)
        n = scores.shape[1]
        ids, known = np.frombuffer(row["ids"], np.int64, n), np.frombuffer(row["ids"], np.uint8, n, 8 * n)
        items = np.frombuffer(row["items"], np.int64)
        slots, docs = [], []
        for slot, own in enumerate(scores):
            some = np.flatnonzero(own > 0)
            if len(some) > k:
                some = some[own[some] >= np.partition(own[some], len(some) - k)[len(some) - k]]
                some = some[np.lexsort((ids[some], 1 - known[some], -own[some]))][:k]
            docs.append(some)
            slots.append(np.full(len(some), slot))
        s, d = np.concatenate(slots), np.concatenate(docs)
        return pa.Table.from_arrays([pa.array(items[s]), pa.array(ids[d], mask=known[d] == 0), pa.array(scores[s, d])], schema=schema)

    return bundles.groupBy("shard", "bundle").cogroup(posts.groupBy("shard", "bundle")).applyInArrow(select, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, owners: int = OWNERS, shard_docs: int = SHARD_DOCS, bundle_items: int = BUNDLE_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    asked = common.stored(item_terms(items))
    terms = asked.select("term").distinct()
    rows = index_shards(docs, shard_docs)
    wanted = small(terms, terms.count()).withColumnRenamed("term", "_t")
    index = common.stored(rows.join(wanted, F.col("term") == F.col("_t"), "left").filter("term is null or _t is not null").drop("_t"))
    shards, posts = index.filter("term is null"), index.filter("term is not null")
    n, total = shards.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    corpus = Corpus(n, max(1, total))

    # the terms' weights and owners, the items' numbers in their bundles
    df = posts.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1)))
    most = F.log((2 * F.lit(n) + 2) / F.lit(3)) * 1000 + 1
    owner = F.greatest(F.lit(0), F.least(F.lit(owners - 1), F.floor(owners * (1 - F.col("w") / most)))).cast("int")
    weights = df.withColumn("w", weight).filter("w > 0").select("term", "w", owner.alias("owner"))
    bundles_n = max(1, -(-asked.select("item_id").distinct().count() // bundle_items))
    numbered = asked.select("item_id").distinct().withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles_n)).cast("int"))
    numbered = common.stored(numbered.withColumn("slot", F.row_number().over(W.partitionBy("bundle").orderBy("item_id")) - 1))
    asks = common.stored(asked.join(weights, "term").join(numbered, "item_id").select("bundle", "slot", "item_id", "term", "w", "owner"))

    # bundles at the start: an item's rest behind an owner is what later owners can add at most
    rests = [F.coalesce(F.sum(F.when(F.col("owner") > s, F.col("w") * MOST)), F.lit(0)).alias(f"r{s}") for s in range(owners)]
    rest = numbered.join(asks.select("bundle", "slot", "w", "owner"), ["bundle", "slot"], "left").groupBy("bundle", "slot", "item_id").agg(*rests)
    gathered = F.sort_array(F.collect_list(F.struct("slot", "item_id", F.array(*(f"r{s}" for s in range(owners))).alias("rest"))))
    heads = common.stored(rest.groupBy("bundle").agg(gathered.alias("g")))  # as many as a bundle has items

    def begin(part: dict) -> dict:
        out: dict = {name: part.get(name, []) for name in ("shard", "bundle", "ids", "lengths")}
        out["items_n"] = [len(g) for g in part["g"]]
        out["items"] = [np.array([x["item_id"] for x in g], np.int64).tobytes() for g in part["g"]]
        out["rest"] = [np.array([x["rest"] for x in g], np.int64).tobytes() for g in part["g"]]
        return out | {"acc": [b""] * len(part["g"])}

    each = shards.select("shard", F.col("docs").alias("ids"), F.col("counts").alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(bundles_n - 1))).alias("bundle"))
    bundles = common.map_batches(each.join(small(heads, bundles_n, 1000), "bundle"), begin, _BUNDLE, _BUNDLES)

    lists = asks.groupBy("owner", "bundle", "term").agg(F.collect_list(F.struct("slot", "w")).alias("asks"))  # as many as a bundle has items
    lists = common.stored(lists)
    n_lists = lists.count()
    met = lambda s: posts.join(small(lists.filter(F.col("owner") == s), n_lists, 100_000), "term").select("shard", "bundle", "docs", "counts", "asks")
    behind = None
    for s in range(owners - 1):
        behind = common.stored(_stage(bundles, met(s), corpus, s, k), instead_of=behind)
        bundles = _pruned(behind, common.stored(_least(behind, k)), s)
    found = _last(bundles, met(owners - 1), corpus, k)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), size AS (
  SELECT r, doc_id, count(*) AS n FROM d GROUP BY r, doc_id
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM size
), tf AS (
  SELECT r, term, count(*) AS tf FROM d GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term
), s AS (
  SELECT q.item_id, size.r, size.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + (50 * size.n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN size ON size.r = tf.r, corpus
  GROUP BY q.item_id, size.r, size.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""

QUERIES = {"op13_lexical_search": op13_lexical_search}
ORACLES = {"op13_lexical_search": ORACLE}
