"""Operator 10, quality classifier: regularised quadratic discriminant over document statistics.

Each whole text gives a vector of transformed statistics.  Class means and covariances come from sums that
Spark adds up over all labelled rows; each covariance is shrunk towards the pooled one and towards a
multiple of the identity, its Cholesky factor is kept, and a score is the logistic of the difference of the
two classes' log densities (Mahalanobis distances through the factors) and log priors.

Defined results: null, empty and blank texts have the statistics of an empty text and get a score as any
other; repeated rows stay; labels other than 0 and 1 are ignored, each label row counts once; where a class
has no labels the score is the share of label 1 (0.5 without labels); a null doc_id is not held out and never
learnt from; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import common
from loomspark.llm.shingles import shingle_hashes, word_hashes

#: Weight of the pooled covariance, and of the scaled identity, in each class's own.
TO_POOLED, TO_IDENTITY = 0.2, 0.05
BROADCAST_IDS = 2_000_000
NAMES = (
    "words", "word_length", "word_length_spread", "upper", "letters", "digits", "symbols", "pipes", "exclamations", "stops", "commas",
    "words_a_line", "distinct_words", "top_word", "adjacent_repeats", "repeated_shingles", "repeated_lines", "short_words",
)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of NAMES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(data), 1)
    b = np.frombuffer(data, dtype=np.uint8)
    count = np.bincount(b, minlength=256)
    blank = int(count[9:14].sum() + count[32])
    upper, digits = int(count[65:91].sum()), int(count[48:58].sum())
    letters = upper + int(count[97:123].sum() + count[128:].sum())
    stops, commas, pipes, marks = (int(count[list(map(ord, s))].sum()) for s in (".?", ",;:", "|", "!"))
    symbols = n - blank - digits - letters - stops - commas - pipes - marks
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = ~np.isin(b, (9, 10, 11, 12, 13, 32))
    edge = np.diff(inside)
    lengths = (edge == -1).nonzero()[0] - (edge == 1).nonzero()[0]
    words = word_hashes(text)
    _, often = np.unique(words, return_counts=True)
    shingles = shingle_hashes(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    def share(k: float, of: int, usual: float, weight: int = 40) -> float:
        """A logit that is defined at 0 and 1; a short text's share is drawn to the usual one."""
        x = (k + usual * weight) / (of + weight)
        return float(np.log((x + 0.001) / (1.001 - x)))

    w = len(words)
    return [
        float(np.log1p(w)),
        float(np.log1p((lengths.sum() + 50) / (w + 10))),
        float(np.log1p(np.sqrt(((lengths - (lengths.mean() if w else 0.0)) ** 2).sum() / (w + 10) + 90 / (w + 10)))),
        share(upper, letters, 0.03),
        share(letters, n, 0.8),
        share(digits, n, 0.002),
        share(max(symbols, 0), n, 0.002),
        share(pipes, n, 0.001),
        share(marks, n, 0.001),
        share(min(stops, w), w, 0.08, 12),
        share(min(commas, w), w, 0.08, 12),
        float(np.log1p((w + 30) / (len(lines) + 1))),
        float(np.log((len(often) + 20) / (w + 20))),
        share(float(often.max()) - 1 if w else 0.0, w, 0.06, 12),
        share(float((words[1:] == words[:-1]).sum()), w, 0.01, 12),
        share(float(len(shingles) - len(np.unique(shingles))), len(shingles), 0.01, 12),
        share(float(len(lines) - len(set(lines))), len(lines), 0.02, 5),
        share(float((lengths <= 3).sum()), w, 0.35, 12),
    ]


@dataclass
class Model:
    """Means, inverse Cholesky factors, log determinants and log priors of the classes 0 and 1."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Likelihood of label 1 for each row of statistics."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.factor[c].T
            density.append(self.log_prior[c] - 0.5 * (self.log_det[c] + (z * z).sum(axis=1)))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def model_of(n: np.ndarray, s: np.ndarray, ss: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Model:
    """The model from each class's count, sum and sum of outer products."""
    d = s.shape[1]
    if n.min() < 2:
        return Model(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), np.zeros(2), float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = s / n[:, None]
    own = np.stack([ss[c] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    factor, log_det = [], []
    for c in (0, 1):
        v = ((1 - to_pooled) * own[c] + to_pooled * pooled) / np.outer(scale, scale)
        v = (1 - to_identity) * v + to_identity * (np.trace(v) / d + 1e-6) * np.eye(d)
        low = np.linalg.cholesky(v)
        factor.append(np.linalg.inv(low) / scale[None, :])
        log_det.append(2 * np.log(np.diag(low)).sum() + 2 * np.log(scale).sum())
    return Model(mean, np.stack(factor), np.array(log_det), np.log(n / n.sum()))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for each row."""
    return common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda p: {"doc_id": p["doc_id"], "stats": [statistics(x) for x in p["text"]]}, "doc_id long, stats array<double>", pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))]))


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the label rows that may be learnt from."""
    return labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from (doc_id, stats) and (doc_id, quality): sums of a few hundred numbers a class reach the driver."""
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            q = np.array(batch.column(0).to_pylist(), dtype=int)
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, d)
            for c in (0, 1):
                own = x[q == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1]), pa.int32()), pa.array(np.tile(np.arange(total.shape[1]), 2), pa.int32()), pa.array(total.ravel())], names=["c", "k", "v"])

    joined = stats.join(labels, "doc_id").select("quality", "stats").mapInArrow(sums, "c int, k int, v double")
    total = np.zeros((2, 1 + d + d * d))
    for r in joined.groupBy("c", "k").agg(F.sum("v").alias("v")).collect():
        total[r["c"], r["k"]] = r["v"]
    return model_of(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = common.checkpoint(with_statistics(common.read(spark, sf_dir, "documents")))
    model = fit(stats, learnable(common.read(spark, sf_dir, "labels")))

    def score(part: dict) -> dict:
        return {"doc_id": part["doc_id"], "score": model.score(np.array(part["stats"], dtype=float).reshape(-1, len(NAMES)))}

    scored = common.map_batches(stats, score, "doc_id long, score double", pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, that score at least so high under a model learnt from their own labels."""
    common.bound_batches(docs.sparkSession)
    known = learnable(labels)
    ids = known.select("doc_id").distinct()
    labelled = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    model, text = fit(with_statistics(labelled), known), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            scores = model.score(np.array([statistics(x) for x in texts]).reshape(-1, len(NAMES)))
            yield batch.filter(pa.array(scores >= least))

    return common.map_rows(docs, keep)


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
