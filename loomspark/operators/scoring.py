"""The best scores of each query, found where the rows of an index lie: only what a task cannot rule out leaves it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of rows and queries, of postings and queries, and of rows and query terms, that are held at a time.
CELLS, PAIRS, TERM_CELLS = 1 << 18, 1 << 21, 1 << 22


def count_words(rows: DataFrame) -> DataFrame:
    """(chunk_id, rel_path, dl, weight, terms, tfs) from (chunk_id, rel_path, weight, words): a row's terms in order with their counts; none without words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch["words"]).to_numpy()
            words = batch["words"].flatten().dictionary_encode()
            order = pc.sort_indices(words.dictionary).to_numpy()
            place = np.empty(len(order), int)
            place[order] = np.arange(len(order))
            key, tf = np.unique(np.repeat(np.arange(len(size)) * len(order), size) + place[words.indices.to_numpy()], return_counts=True)
            some = np.nonzero(size)[0]
            ends = pa.array(np.r_[np.searchsorted(key, some * len(order)), len(key)], pa.int32())
            terms = words.dictionary.take(pa.array(order[key % max(1, len(order))]))
            lists = [pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))]
            kept = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([kept["chunk_id"], kept["rel_path"], pa.array(size[some], pa.int32()), kept["weight"], *lists], ["chunk_id", "rel_path", "dl", "weight", "terms", "tfs"])

    kind = dict(rows.dtypes)["chunk_id"]
    return rows.select("chunk_id", "rel_path", "weight", "words").mapInArrow(task, f"chunk_id {kind}, rel_path string, dl int, weight double, terms array<string>, tfs array<long>")


def send_terms(wanted: DataFrame) -> Broadcast:
    """Query terms (query_id, term, idf), few enough to be broadcast, as distinct terms with their idf and the places of their queries."""
    rows = wanted.select("query_id", "term", "idf").sort("term", "query_id").toArrow()
    ids, terms = pc.unique(rows["query_id"]), pc.unique(rows["term"])
    counts = np.bincount(pc.index_in(rows["term"], value_set=terms).to_numpy(), minlength=len(terms))
    starts = np.cumsum(counts) - counts
    idf = rows["idf"].to_numpy()[starts].astype(float)
    return wanted.sparkSession.sparkContext.broadcast((ids, terms, idf, starts, counts, pc.index_in(rows["query_id"], value_set=ids).to_numpy()))


def _summed(row: np.ndarray, term: np.ndarray, part: np.ndarray, rows: int, queries: int, sent: tuple) -> np.ndarray:
    """rows x queries: the parts of the terms, for each query that has the term."""
    _, _, _, starts, counts, owners = sent
    n = counts[term]
    at = np.repeat(starts[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.bincount(np.repeat(row * queries, n) + owners[at], weights=np.repeat(part, n), minlength=rows * queries).reshape(rows, queries)


def _first(query: np.ndarray, code: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k best items by score, then code; an item counts once, with its best score."""
    order = np.lexsort((-score, code, query))
    order = order[np.r_[True, (np.diff(query[order]) != 0) | (np.diff(code[order]) != 0)]] if len(order) else order
    order = order[np.lexsort((code[order], -score[order], query[order]))]
    if not len(order):
        return order
    begin = np.r_[True, np.diff(query[order]) != 0]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))
    return order[place < k]


class _Pool:
    """The k best items of each query so far, and what a score must reach to be among them."""

    def __init__(self, k: int, queries: int, item_type: np.dtype) -> None:
        self.k, self.floor = k, np.zeros(queries)
        self.query, self.item, self.score = np.zeros(0, int), np.zeros(0, item_type), np.zeros(0)

    def add(self, query: np.ndarray, row: np.ndarray, items: np.ndarray, score: np.ndarray) -> None:
        some = _first(query, np.unique(items, return_inverse=True)[1][row], score, self.k)
        self.query, self.item, self.score = np.r_[self.query, query[some]], np.r_[self.item, items[row[some]]], np.r_[self.score, score[some]]
        if len(self.query) > 2 * self.k * len(self.floor) or len(some) > len(self.floor):
            self.cut()

    def cut(self) -> None:
        kept = _first(self.query, np.unique(self.item, return_inverse=True)[1], self.score, self.k)
        self.query, self.item, self.score = self.query[kept], self.item[kept], self.score[kept]
        full = np.bincount(self.query, minlength=len(self.floor)) >= self.k
        least = np.full(len(self.floor), np.inf)
        np.minimum.at(least, self.query, self.score)
        self.floor = np.where(full, least, 0.0)


def _blocks(pairs: np.ndarray, queries: int, terms: int = 1) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most CELLS and TERM_CELLS cells and PAIRS pairs, a row at least."""
    done, lo, most = np.cumsum(pairs), 0, min(CELLS // queries, TERM_CELLS // terms)
    while lo < len(pairs):
        hi = int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, "right"))
        hi = max(lo + 1, min(hi, lo + max(1, most), len(pairs)))
        yield lo, hi
        lo = hi


def _inside(paths: list[str | None], terms: dict[str, int], lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) for the terms inside each path, once each."""
    rows, found = [], []
    for row, path in enumerate(paths):
        held = {terms[x] for n in lengths for i in range(len(path or "") - n + 1) if (x := path[i : i + n]) in terms}
        rows += [row] * len(held)
        found += held
    return np.array(rows, int), np.array(found, int)


def best_rows(rows: DataFrame, wanted: DataFrame, k: int, value: Column, share: float = 1.0, slack: float = 0.0, path_slack: float = 0.0) -> DataFrame:
    """(query_id, item, score): each query's k best items, at six decimals, of every task; with a share or slack, all that may reach the share of
    the k-th best when slack, and path_slack for each term in the path, are added.

    rows (item, path, weight, terms, ...): value is the array of the terms' values without idf, which wanted (query_id, term, idf) has.  A row's
    score is the sum of idf * value over the query's terms that it holds, and of those in its path the idf, times weight; rows that hold none
    have no score.  path may be null.  An item that has several rows counts with the best.
    """
    sent = send_terms(wanted)
    exact = share == 1.0 and not slack and not path_slack
    kinds = dict(rows.dtypes) | {f"q_{n}": t for n, t in wanted.dtypes}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, idf, _, counts, _ = sent.value
        queries, pool, number = len(ids), None, {t: i for i, t in enumerate(terms.to_pylist())}
        lengths = sorted({len(t) for t in number})

        def out(query: np.ndarray, item: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(query)), pa.array(item, item_type), pa.array(score, pa.float64())], ["query_id", "item", "score"])

        for batch in batches:
            item_type = batch["item"].type
            items, weight = batch["item"].to_numpy(zero_copy_only=False), batch["weight"].to_numpy()
            pool = pool or _Pool(k, queries, items.dtype)
            size = pc.list_value_length(batch["terms"]).to_numpy()
            term = pc.fill_null(pc.index_in(batch["terms"].flatten(), value_set=terms), -1).to_numpy()
            row, amount = np.repeat(np.arange(len(size)), size)[term >= 0], batch["value"].flatten().to_numpy()[term >= 0]
            term = term[term >= 0]
            p_row, p_term = _inside(batch["path"].to_pylist(), number, lengths)
            pairs = np.bincount(row, counts[term], len(size)) + np.bincount(p_row, counts[p_term], len(size))
            for lo, hi in _blocks(pairs, queries):
                a, b = np.searchsorted(row, [lo, hi])
                c, d = np.searchsorted(p_row, [lo, hi])
                score = _summed(row[a:b] - lo, term[a:b], amount[a:b] * idf[term[a:b]], hi - lo, queries, sent.value)
                more = np.zeros(1)
                if c < d:
                    score += np.where(score > 0, _summed(p_row[c:d] - lo, p_term[c:d], idf[p_term[c:d]], hi - lo, queries, sent.value), 0.0)
                    if path_slack:
                        more = path_slack * _summed(p_row[c:d] - lo, p_term[c:d], np.ones(d - c), hi - lo, queries, sent.value)
                score = np.floor(score * weight[lo:hi, None] * 1e6 + 0.5) / 1e6
                r, q = np.nonzero((score > 0) & (score >= pool.floor))
                pool.add(q, r, items[lo:hi], score[r, q])
                if not exact:
                    r, q = np.nonzero((score > 0) & (score + more + slack + 1e-6 >= share * pool.floor))
                    yield out(q, items[lo:hi][r], score[r, q])
        if exact and pool:
            pool.cut()
            yield out(pool.query, pool.item, pool.score)

    lean = rows.select("item", F.lower("path").alias("path"), F.col("weight").cast("double").alias("weight"), "terms", value.cast("array<double>").alias("value"))
    return lean.mapInArrow(task, f"query_id {kinds['q_query_id']}, item {kinds['item']}, score double")


def _spread(rows: np.ndarray, codes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): for each row's code the places from its start on, as many as its count."""
    n = counts[codes]
    return np.repeat(rows, n), np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def best_hits(rows: DataFrame, wanted: DataFrame, k: int, inside: bool) -> DataFrame:
    """(query_id, item, hits): each query's k best items of every task by occurrences of its terms, ties to the smaller item.

    rows (item, path, words), an item in one row; wanted (query_id, term).  A term counts as often as it is a word, or lies inside the words, and
    2 if it lies in the path, also alone.  A batch's distinct words meet the terms once; a row's terms are summed before they meet their queries.
    """
    sent = send_terms(wanted.withColumn("idf", F.lit(1.0)))
    kinds = dict(rows.dtypes) | {f"q_{n}": t for n, t in wanted.dtypes}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, _, _, _, _ = sent.value
        queries, width, pool, number = len(ids), len(terms), None, {t: i for i, t in enumerate(terms.to_pylist())}
        lengths = sorted({len(t) for t in number})
        for batch in batches if queries else ():
            item_type, items = batch["item"].type, batch["item"].to_numpy(zero_copy_only=False)
            pool = pool or _Pool(k, queries, items.dtype)
            words, paths = batch["words"].flatten().dictionary_encode(), batch["path"].dictionary_encode()
            known = words.dictionary.to_pylist()
            if inside:
                w, term = _inside(known, number, lengths)
                names = terms.to_pylist()
                amount = np.array([known[a].count(names[b]) for a, b in zip(w.tolist(), term.tolist(), strict=True)], float)
            else:
                term = pc.fill_null(pc.index_in(words.dictionary, value_set=terms), -1).to_numpy()
                w, term = np.nonzero(term >= 0)[0], term[term >= 0]
                amount = np.ones(len(w))
            p, p_term = _inside(paths.dictionary.to_pylist(), number, lengths)
            n, p_n = np.bincount(w, minlength=len(known)), np.bincount(p, minlength=len(paths.dictionary))
            begin, p_begin = np.cumsum(n) - n, np.cumsum(p_n) - p_n
            size, code = pc.list_value_length(batch["words"]).to_numpy(), words.indices.to_numpy()
            row, of = np.repeat(np.arange(len(size)), size), pc.fill_null(paths.indices, -1).to_numpy()
            has = np.nonzero(of >= 0)[0]
            for lo, hi in _blocks(np.bincount(row, n[code], len(size)), queries, width):
                a, b = np.searchsorted(row, [lo, hi])
                r, at = _spread(row[a:b] - lo, code[a:b], begin, n)
                own = has[slice(*np.searchsorted(has, [lo, hi]))]
                r2, at2 = _spread(own - lo, of[own], p_begin, p_n)
                held = np.bincount(np.r_[r * width + term[at], r2 * width + p_term[at2]], weights=np.r_[amount[at], np.full(len(r2), 2.0)], minlength=(hi - lo) * width)
                cell = np.flatnonzero(held)
                hits = _summed(cell // width, cell % width, held[cell], hi - lo, queries, sent.value)
                r, q = np.nonzero((hits > 0) & (hits >= pool.floor))
                pool.add(q, r, items[lo:hi], hits[r, q])
        if pool:
            pool.cut()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(pool.query)), pa.array(pool.item, item_type), pa.array(pool.score.astype(int), pa.int64())], ["query_id", "item", "hits"])

    lean = rows.select("item", F.lower("path").alias("path"), "words")
    return lean.mapInArrow(task, f"query_id {kinds['q_query_id']}, item {kinds['item']}, hits long")
