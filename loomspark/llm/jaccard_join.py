"""Operator 4, exact n-gram Jaccard join under several global token orders.

Two documents link when their shingle sets have a Jaccard similarity of at least 80/100.  The join is
exact.  It rests on the prefix filter: under any order of the tokens that all documents share, linked sets
share a token among their first ``n - need + 1``, and ``k`` tokens among their first
``n - need + k``, where ``need = ceil(0.8 n)`` is the least overlap that a set of n tokens can link with.

1. One pass over the texts gives each set's size, digest and first tokens of order A (by hash value).  Equal sets
   become one representative (its smallest id); only representatives go on.
2. Order A: a set's first ``n - need + k`` tokens are indexed, and a set goes on only when
   at least ``k`` of them occur in another set.  Most documents end here, at a quarter of the tokens.
3. Order B, rarest first, over all tokens of what is left: sets with fewer than ``need`` tokens that
   others have cannot link; for the rest, the prefix in this order is indexed.
4. Hubs: each set is first compared with the sets that most often stand first in its posting lists, which
   joins large groups of near copies at a few pairs a row.  Step 3's counts are then taken anew
   between the components found, so that what lies inside one component costs nothing more.
5. What is left are candidates of order B: short posting lists as pairs between components, long ones dealt by
   (token, size class, block), see ``blocks``.  Both must also share prefix tokens under order A and under
   order C (hash values descending); pairs are tested so on their prefixes before whole sets are shipped.

Defined results: null, empty and blank texts have the empty set, which links with nothing; rows that
share an id are one document; a row without an id has its set's size, and links with nothing but equal sets: its component
is theirs, or null; texts of any length are taken whole; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.llm import blocks, common
from loomspark.llm.shingles import WORDS_PER_SHINGLE, shingle_set

PERCENT = 80
HUBS = 3
#: A posting list of up to this length is compared as pairs, a longer one in blocks.
SHORT_LIST = 48
#: Ids up to this count are few enough (32 MB) to be broadcast.
BROADCAST_IDS = 2_000_000


def need(n: int, percent: int = PERCENT) -> int:
    """Least overlap with which a set of n tokens can reach the threshold."""
    return -(-n * percent // 100)


def margin(n: int) -> int:
    """k of the filter under order A: a tenth of the set."""
    return max(1, n // 10)


def least_margin(n: int, percent: int = PERCENT) -> int:
    """The smallest k among the sets that a set of n tokens can link with."""
    return margin(need(n, percent))


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("first", pa.binary())])


def token_bytes(n_sets: int) -> int:
    """High bytes of a token that an index over so many sets needs.

    Tokens that become equal only let more sets pass a filter, so the join stays exact; with 14 bits beyond the
    number of tokens such cases are rare.
    """
    return min(8, -(-(14 + (256 * max(1, n_sets)).bit_length()) // 8))


def set_keys(docs: DataFrame, width: int = 8, n_words: int = WORDS_PER_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, key, first): size and digest of each document's set (null of the empty one), and order A's first tokens, `width` bytes each."""

    def keys(part: dict) -> dict:
        sets = [shingle_set(x, n_words) for x in part["text"]]
        first = [(s[: len(s) - need(len(s), percent) + margin(len(s))] >> np.uint64(64 - 8 * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() for s in sets]
        return {"doc_id": part["doc_id"], "n": [len(s) for s in sets], "key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], "first": first}

    return common.map_batches(docs.select("doc_id", "text"), keys, "doc_id long, n long, key binary, first binary", _SETS)


def _first_tokens(rows: DataFrame, width: int) -> DataFrame:
    """(token, doc_id), a row for each of order A's first tokens."""
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            cut = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
            tokens = np.zeros((len(cut), 8), np.uint8)
            tokens[:, :width] = cut
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view("<i8").ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) // width for x in raw]), pa.int64())], schema=schema)

    return rows.select("doc_id", "first").mapInArrow(common.giving_back(run), "token long, doc_id long")


def _need(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def _margin(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / 10))


def _semi(rows: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    return rows.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _shared(tokens: DataFrame, by: str) -> DataFrame:
    """The rows whose token occurs with several values of by; counted before they are shuffled."""
    often = tokens.groupBy("token").agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.count("*").alias("df")).filter("lo <> hi").select("token", "df", F.col("lo").alias("hub"))
    return tokens.join(often, "token")


def _prefix(shared: DataFrame, percent: int) -> DataFrame:
    """The postings of order B (rarest first) that a set must share one of; unshared tokens come first."""
    own = W.partitionBy("doc_id")
    ranked = shared.withColumn("m", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("df", "token")))
    return ranked.filter((F.col("m") >= _need(F.col("n"), percent)) & (F.col("r") <= F.col("m") - _need(F.col("n"), percent) + 1))


def _sets_of(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in raw]


def _maybe(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """The pairs (src, dst) that share a token of their prefix under order A and under order C."""
    width = 8 * (F.col("n") - _need(F.col("n"), percent) + 1).cast("int")
    prefixes = live.select(F.col("doc_id").alias("id"), F.substr("tokens", F.lit(1), width).alias("a"), F.substr("tokens", -width, width).alias("c"))

    def check(part: dict) -> dict:
        keep = []
        for k, (xa, ya, xc, yc) in enumerate(zip(part["xa"], part["ya"], part["xc"], part["yc"], strict=True)):
            if all(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in ((xa, ya), (xc, yc))):
                keep.append(k)
        return {side: [part[side][k] for k in keep] for side in ("src", "dst")}

    x, y = prefixes.toDF("src", "xa", "xc"), prefixes.toDF("dst", "ya", "yc")
    joined = pairs.join(x, "src").join(y, "dst").select("src", "dst", "xa", "ya", "xc", "yc")
    return common.map_batches(joined, check, "src long, dst long", pa.schema([("src", pa.int64()), ("dst", pa.int64())]))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, n_words: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = token_bytes(docs.count())
    shift = 64 - 8 * width
    keyed = common.checkpoint(set_keys(docs, width, n_words, percent))
    reps = keyed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    n_reps = reps.count()
    rep_ids = reps.select(F.col("rep").alias("doc_id"))
    wanted = docs.dropna(subset=["doc_id"])

    # order A
    first = _first_tokens(_semi(keyed.filter("key is not null"), rep_ids, n_reps), width)
    often = first.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token")
    shared = first.join(often, "token").groupBy("doc_id").agg(F.count("*").alias("m"))
    sizes = keyed.groupBy("doc_id").agg(F.min("n").alias("n"))
    alive = common.checkpoint(shared.join(sizes, "doc_id").filter(F.col("m") >= _margin(_need(F.col("n"), percent))).select("doc_id"))
    n_alive = alive.count()

    # order B
    def whole(part: dict) -> dict:
        made = [shingle_set(x, n_words) for x in part["text"]]
        return {"doc_id": part["doc_id"], "n": [len(s) for s in made], "tokens": [s.tobytes() for s in made]}

    sets = common.map_batches(_semi(wanted, alive, n_alive), whole, "doc_id long, n long, tokens binary", pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())]))
    sets = common.checkpoint(sets.filter("n > 0"))
    postings = common.checkpoint(_prefixes(sets, None, shift, percent).select("doc_id", "hub"))
    live = common.checkpoint(sets.join(postings.select("doc_id").distinct(), "doc_id", "left_semi"))
    hub_of = postings.filter("hub <> doc_id").groupBy("doc_id", "hub").agg(F.count("*").alias("lists"))
    best = W.partitionBy("doc_id").orderBy(F.desc("lists"), "hub")
    hubs = hub_of.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= HUBS).select(F.col("hub").alias("src"), F.col("doc_id").alias("dst"))
    payload = live.select(F.col("doc_id").alias("id"), F.col("tokens").alias("payload"))
    links = common.checkpoint(blocks.verified(hubs, payload, _sets_of, percent))
    labels = common.components(links)

    # between components
    rest = common.checkpoint(_prefixes(live, labels, shift, percent).select("token", "doc_id", "n", "component"))
    lists = rest.groupBy("token").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    lists = common.checkpoint(lists.select("token", "members"))
    open_ = rest.join(blocks.small(lists, lists.count()), "token")
    short, long_ = open_.filter(F.col("members") <= SHORT_LIST), open_.filter(F.col("members") > SHORT_LIST)
    a = short.select("token", F.col("doc_id").alias("src"), F.col("n").alias("sn"), F.col("component").alias("sc"))
    b = short.select("token", F.col("doc_id").alias("dst"), F.col("n").alias("dn"), F.col("component").alias("dc"))
    pairs = a.join(b, "token").filter(f"src < dst and sc <> dc and 100 * least(sn, dn) >= {percent} * greatest(sn, dn)").select("src", "dst").distinct()
    maybe = common.checkpoint(_maybe(pairs, live, percent))
    long_ = long_.select("token", F.col("doc_id").alias("id"), "n", "component")
    late = common.checkpoint(blocks.verified(maybe, payload, _sets_of, percent).union(blocks.block_links(long_, payload, _sets_of, percent)))
    labels = common.components(links.union(late))
    of_key = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    return keyed.join(of_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _prefixes(sets: DataFrame, labels: DataFrame | None, shift: int, percent: int) -> DataFrame:
    """Order B's postings; with labels, only what several components share counts."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [np.frombuffer(x, np.uint64) for x in part.column(2).to_pylist()]
                lengths = [len(s) for s in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(((np.concatenate(own) if own else np.empty(0, np.uint64)) >> np.uint64(shift)).view(np.int64)), *(pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), lengths)) for c in (0, 1, 3))], names=["token", "doc_id", "n", "component"]
                )

    if labels is None:
        with_component = sets.withColumn("component", F.col("doc_id"))
    else:
        with_component = sets.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n", "tokens", F.coalesce("component", "doc_id").alias("component"))
    tokens = with_component.select("doc_id", "n", "tokens", "component").mapInArrow(common.giving_back(flat), "token long, doc_id long, n long, component long")
    return _prefix(_shared(tokens, "component"), percent)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.read(spark, sf_dir, "documents"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLES: dict[str, str] = {}
