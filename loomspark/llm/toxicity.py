"""Operator 6, toxicity by a classifier chain.

The categories are predicted one after another; each linear (logistic) model takes the word features and
the probabilities of the categories before it.  While learning, those probabilities are out-of-fold
predictions, so that a later model never sees an earlier one's fit to its own label.  Folds are dealt by a hash of the ids and
are even: with two rows or more, several have rows.

``labels`` marks a document as toxic and as of good or poor quality; the chain's categories are abuse within
junk, abuse within prose, and toxic as such, which decides.  Features are those words (runs of letters, lower
case) and beginnings of words whose presence says most about the label by chi-square over the learning rows;
beginnings catch inflected and compound forms that no single word list has.

The model is learnt from at most FIT_ROWS labelled documents, those whose doc_id has the smallest hash, one text
an id; every document is scored whole, in one pass without a shuffle.

Defined results: null and empty texts have no words and get the score of the intercepts; repeated rows stay;
a label row counts if toxic is 0 or 1 and quality 0, 1 or null (then 1), and of an id's label rows and texts the
smallest; without both labels every score is the share of toxic labels (0 without labels); an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import common
from loomspark.llm.shingles import mix64

FIT_ROWS = 10_000
WORD_FEATURES = 512
FOLDS = 4
#: Lengths of the beginnings of words, in letters.
BEGINNINGS = range(3, 11)
#: Words whose features a worker remembers.
MEMO_WORDS = 150_000
RIDGE = 0.3
CATEGORIES = ("toxic_junk", "toxic_prose", "toxic")
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_features(word: str) -> list[str]:
    """The word itself (marked as whole) and its beginnings."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if k <= len(word))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights of a ridge-penalised logistic model by Newton's method; the last column of x is the intercept's."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        move = np.linalg.solve((x.T * v) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= move
        if np.abs(move).max() < 1e-3:
            break
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


@dataclass
class Chain:
    """The words looked for, and the weights of each category's model in order."""

    index: dict[str, int]  # of features
    weights: list[np.ndarray]
    constant: float | None = None

    def features(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.index) + 1))
        x[:, -1] = 1
        memo: dict[str, list[int]] = self.__dict__.setdefault("_memo", {})
        for i, text in enumerate(texts):
            for w in words(text):
                found = memo.get(w)
                if found is None:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    found = memo[w] = [self.index[f] for f in word_features(w) if f in self.index]
                for k in found:
                    x[i, k] += 1
        x[:, :-1] = np.log1p(x[:, :-1])
        return x

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """One column for each category; earlier ones feed later ones."""
        if self.constant is not None:
            return np.full((len(texts), len(CATEGORIES)), self.constant)
        x, done = self.features(texts), []
        for w in self.weights:
            done.append(_predict(np.column_stack([*map(_logit, done), x]), w))
        return np.column_stack(done)


def folds(doc_ids: np.ndarray) -> np.ndarray:
    """Each row's fold: rows are dealt in turn in the order of their ids' hashes, so that folds are even whatever the ids."""
    order = np.argsort(mix64(doc_ids.astype(np.int64).view(np.uint64)), kind="stable")
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.arange(len(order)) % FOLDS
    return out


def fit_chain(x: np.ndarray, targets: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """Weights for each column of targets in order, from features x and each row's fold."""
    weights, before = [], []
    for c in range(targets.shape[1]):
        own = np.column_stack([*map(_logit, before), x])
        y = targets[:, c]
        weights.append(logistic(own, y))
        if c + 1 == targets.shape[1]:
            break
        out = np.zeros(len(y))
        for k in np.unique(fold):
            test = fold == k
            if test.all():
                raise ValueError("out-of-fold predictions need rows in several folds")
            out[test] = _predict(own[test], logistic(own[~test], y[~test]))
        before.append(out)
    return weights


def learnable(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, toxic, quality, text): at most `rows` labelled documents, one row an id."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    valid = labels.filter("toxic in (0, 1) and (quality is null or quality in (0, 1)) and doc_id is not null")
    marked = valid.groupBy(doc_id).agg(F.min(F.struct(F.col("toxic").cast("int").alias("toxic"), F.coalesce("quality", F.lit(1)).cast("int").alias("quality"))).alias("marks"))
    known = marked.join(docs.select(doc_id).distinct(), "doc_id", "left_semi")
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))  # rows is the bound of its size
    texts = docs.select(doc_id, "text").join(sample, "doc_id").groupBy("doc_id").agg(F.first("marks").alias("marks"), F.min("text").alias("text"))
    return texts.select("doc_id", "marks.toxic", "marks.quality", "text")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, features: int = WORD_FEATURES) -> Chain:
    """Learn the chain; features of at most `rows` documents, one row each, reach the driver."""
    common.bound_batches(docs.sparkSession)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a text has many features; few texts at a time bound the memory
                part = batch.slice(at, 64)
                toxic, rows_ = part.column(0).to_pylist(), [list({f for w in set(words(x)) for f in word_features(w)}) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([w for r in rows_ for w in r], pa.string()), pa.array(np.repeat(np.array(toxic, np.int64), [len(r) for r in rows_]))], names=["word", "toxic"])

    sampled = common.checkpoint(learnable(docs, labels, rows))
    totals = sampled.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = totals["n"], totals["t"] or 0
    if not 0 < t < n:
        return Chain({}, [], t / n if n else 0.0)
    seen = sampled.select("toxic", "text").mapInArrow(common.giving_back(distinct), "word string, toxic long").groupBy("word").agg(F.count("*").cast("double").alias("df"), F.sum("toxic").cast("double").alias("tf"))
    # chi-square of presence against the label
    a, b = F.col("tf"), F.col("df") - F.col("tf")
    c, d = F.lit(float(t)) - a, F.lit(float(n - t)) - b
    chi = n * F.pow(a * d - b * c, 2) / (F.col("df") * (n - F.col("df")) * t * (n - t))
    top = seen.filter(f"df >= 3 and df < {n}").select("word", chi.alias("chi")).orderBy(F.desc("chi"), "word").limit(features)
    index = {r["word"]: k for k, r in enumerate(top.collect())}
    chain = Chain(index, [])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, common.STEP_ROWS):
                part = batch.slice(at, common.STEP_ROWS)
                x = chain.features(part.column(3).to_pylist())[:, :-1].astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "toxic", "quality", "x"])

    got = sampled.mapInArrow(common.giving_back(rows_of), "doc_id long, toxic int, quality int, x binary").orderBy("doc_id").toPandas()
    x = np.stack([np.frombuffer(v, np.float32) for v in got["x"]]).astype(float) if len(index) else np.zeros((len(got), 0))
    x = np.column_stack([x, np.ones(len(x))])
    toxic, quality = got["toxic"].to_numpy(float), got["quality"].to_numpy(float)
    targets = np.column_stack([toxic * (1 - quality), toxic * quality, toxic])
    chain.weights = fit_chain(x, targets, folds(got["doc_id"].to_numpy()))
    return chain


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, toxic_junk, toxic_prose, score, toxic) for each document."""
    docs = common.read(spark, sf_dir, "documents")
    chain = fit(docs, common.read(spark, sf_dir, "labels"))

    def score(part: dict) -> dict:
        p = chain.probabilities(part["text"])
        return {"doc_id": part["doc_id"], "toxic_junk": p[:, 0], "toxic_prose": p[:, 1], "score": p[:, 2], "toxic": (p[:, 2] >= 0.5).astype(int)}

    schema = pa.schema([("doc_id", pa.int64()), ("toxic_junk", pa.float64()), ("toxic_prose", pa.float64()), ("score", pa.float64()), ("toxic", pa.int32())])
    return common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score, "doc_id long, toxic_junk double, toxic_prose double, score double, toxic int", schema)


def clean_documents(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, whose toxicity is below `most`."""
    chain, text = fit(docs, labels), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, common.STEP_ROWS):
                part = batch.slice(at, common.STEP_ROWS)
                p = chain.probabilities(part.column(text).to_pylist())
                yield part.filter(pa.array(p[:, -1] < most))

    return common.map_rows(docs, keep)


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
