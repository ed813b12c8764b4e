import zlib

import numpy as np
import pytest
from cases import frame, odd_documents

from loomspark.llm import quality, toxicity

TABLES = "/root/testdata/sf0.1"


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in quality.op10_quality(spark, TABLES).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in labels)
    held = [(rows[i], q) for i, q in labels if rows[i].held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.98
    assert np.mean([r.predicted == 0 for r, q in held if q == 0]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, None), (8, 5), (None, 1)], "doc_id long, quality int")
    stats = quality.with_statistics(frame(spark, odd_documents()))
    model = quality.fit(stats, quality.learnable(labels))
    assert model.constant is not None  # one row of a class says nothing about its spread
    assert quality.fit(stats.limit(0), quality.learnable(labels.limit(0))).constant == 0.5
    assert len(quality.good_documents(frame(spark, odd_documents()), labels.limit(0)).collect()) == len(odd_documents())
    assert quality.good_documents(frame(spark, []), labels).collect() == []


def brute_statistics(text):
    """The statistics of a text, from its words and characters in plain Python."""
    import math

    text = text or ""
    data, w = text.encode(), [x.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in text.encode().split()]
    n, size = max(len(data), 1), [len(x) for x in w]
    num = lambda chars: sum(data.count(bytes([b])) for b in chars)
    upper, digits, blank = num(range(65, 91)), num(range(48, 58)), num([9, 10, 11, 12, 13, 32])
    letters = upper + num(range(97, 123)) + sum(b >= 128 for b in data)
    stops, commas, pipes, marks = num(b".?"), num(b",;:"), num(b"|"), num(b"!")
    symbols = max(n - blank - digits - letters - stops - commas - pipes - marks, 0)
    lines = [x for x in data.split(b"\n") if x.strip()]
    shingles = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []

    def share(k, of, usual, weight=40):
        x = (k + usual * weight) / (of + weight)
        return math.log((x + 0.001) / (1.001 - x))

    mean = sum(size) / len(w) if w else 0
    return [
        math.log1p(len(w)), math.log1p((sum(size) + 50) / (len(w) + 10)), math.log1p(math.sqrt((sum((x - mean) ** 2 for x in size) + 90) / (len(w) + 10))),
        share(upper, letters, 0.03), share(letters, n, 0.8), share(digits, n, 0.002), share(symbols, n, 0.002), share(pipes, n, 0.001), share(marks, n, 0.001),
        share(min(stops, len(w)), len(w), 0.08, 12), share(min(commas, len(w)), len(w), 0.08, 12), math.log1p((len(w) + 30) / (len(lines) + 1)), math.log((len(set(w)) + 20) / (len(w) + 20)),
        share(max(map(w.count, set(w))) - 1 if w else 0, len(w), 0.06, 12), share(sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w), 0.01, 12),
        share(len(shingles) - len(set(shingles)), len(shingles), 0.01, 12), share(len(lines) - len(set(lines)), len(lines), 0.02, 5), share(sum(x <= 3 for x in size), len(w), 0.35, 12),
    ]


def test_statistics_match_brute_force(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [r[1] for r in odd_documents()]
    for text in texts:
        assert quality.statistics(text) == pytest.approx(brute_statistics(text), abs=1e-9)


def test_quality_query_matches_brute_force(spark, small):
    """Means and covariances from numpy over all learnable rows, densities with an explicit inverse."""
    docs = {r.doc_id: quality.statistics(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{small}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x = [np.array([docs[i] for i, q in labels if q == c and i in docs]) for c in (0, 1)]
    cov = [np.cov(v.T, bias=True) for v in x]
    pooled = sum(len(v) * c for v, c in zip(x, cov, strict=True)) / sum(map(len, x))
    scale = np.diag(np.sqrt(np.diag(pooled)))
    density = []
    for c in (0, 1):
        v = np.linalg.inv(scale) @ ((1 - quality.TO_POOLED) * cov[c] + quality.TO_POOLED * pooled) @ np.linalg.inv(scale)
        v = (1 - quality.TO_IDENTITY) * v + quality.TO_IDENTITY * (np.trace(v) / len(v) + 1e-6) * np.eye(len(v))
        v = scale @ v @ scale
        density.append({i: np.log(len(x[c])) - 0.5 * np.linalg.slogdet(v)[1] - 0.5 * (np.array(s) - x[c].mean(0)) @ np.linalg.inv(v) @ (np.array(s) - x[c].mean(0)) for i, s in docs.items()})
    got = {r.doc_id: r.score for r in quality.op10_quality(spark, small).collect()}
    want = {i: 1 / (1 + np.exp(-np.clip(density[1][i] - density[0][i], -500, 500))) for i in docs}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_discriminant_scores_equal_log_densities():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (500, 3)), rng.normal(1, 2, (400, 3))
    model = quality.model_of(np.array([500.0, 400.0]), np.stack([a.sum(0), b.sum(0)]), np.stack([a.T @ a, b.T @ b]), 0.0, 0.0)

    def log_density(x, data):
        cov = np.cov(data.T, bias=True) + 0
        d = x - data.mean(0)
        return -0.5 * (np.log(np.linalg.det(cov)) + d @ np.linalg.solve(cov, d))

    for x in a[:20]:
        want = 1 / (1 + np.exp(log_density(x, a) + np.log(500 / 900) - log_density(x, b) - np.log(400 / 900)))
        assert model.score(x[None, :])[0] == pytest.approx(want, abs=1e-4)


def test_toxicity_on_rows_not_learnt_from(spark):
    docs, labels = spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")
    chain = toxicity.fit(docs, labels.filter("doc_id % 3 <> 1"))
    test = docs.join(labels.filter("doc_id % 3 = 1"), "doc_id").collect()
    p = chain.probabilities([r.text for r in test])
    toxic, quality_ = np.array([r.toxic for r in test]), np.array([r.quality for r in test])
    assert p.shape[1] == len(toxicity.CATEGORIES)
    assert (p[toxic == 0, 2] >= 0.5).mean() < 0.005
    # labels of junk may stay when its words were replaced, so prose is what is held to
    assert (p[(toxic == 1) & (quality_ == 1), 2] >= 0.5).mean() > 0.95


def brute_toxicity(docs, labels, rows=toxicity.FIT_ROWS):
    """Scores of op6 from plain loops: {doc_id: score of the last link}."""
    texts, marks = {}, {}
    for i, text in docs:
        if i is not None and (i not in texts or (text is not None and (texts[i] is None or text < texts[i]))):
            texts[i] = text
    for i, toxic, quality_ in labels:
        if i in texts and toxic in (0, 1) and quality_ in (0, 1, None):
            mark = (toxic, 1 if quality_ is None else quality_)
            marks[i] = min(mark, marks.get(i, mark))
    assert len(marks) <= rows
    ids = sorted(marks)
    toxic = np.array([marks[i][0] for i in ids], float)
    n, t = len(ids), int(toxic.sum())
    has = [{w[:k] for w in toxicity.words(texts[i]) for k in range(3, 11) if k <= len(w)} | {w + "$" for w in toxicity.words(texts[i])} for i in ids]
    chi = {}
    for f in set().union(*has):
        df, tf = sum(f in h for h in has), sum(f in h and m == 1 for h, m in zip(has, toxic, strict=True))
        if 3 <= df < n:
            a, b, c, d = tf, df - tf, t - tf, n - t - (df - tf)
            chi[f] = n * (a * d - b * c) ** 2 / (df * (n - df) * t * (n - t))
    index = {f: k for k, f in enumerate(sorted(chi, key=lambda f: (-chi[f], f))[: toxicity.WORD_FEATURES])}

    def row(text):
        x = np.zeros(len(index) + 1)
        for w in toxicity.words(text):
            for f in toxicity.word_features(w):
                if f in index:
                    x[index[f]] += 1
        x[:-1] = np.log1p(x[:-1])
        x[-1] = 1
        return x

    def newton(x, y):
        w, penalty = np.zeros(x.shape[1]), np.array([toxicity.RIDGE] * (x.shape[1] - 1) + [1e-6])
        for _ in range(25):
            p = 1 / (1 + np.exp(-(x @ w)))
            move = np.linalg.inv(x.T @ np.diag(np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(penalty)) @ (x.T @ (p - y) + penalty * w)
            w = w - move
            if abs(move).max() < 1e-3:
                break
        return w

    predict = lambda x, w: 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    logit = lambda p: np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3)))
    x, q, fold = np.stack([row(texts[i]) for i in ids]), np.array([marks[i][1] for i in ids], float), np.array(ids) % toxicity.FOLDS
    weights, before = [], []
    for y in (toxic * (1 - q), toxic * q, toxic):
        own = np.column_stack([*map(logit, before), x])
        weights.append(newton(own, y))
        out = np.zeros(n)
        for k in range(toxicity.FOLDS):
            out[fold == k] = predict(own[fold == k], newton(own[fold != k], y[fold != k]))
        before.append(out)
    scores = []
    for i, text in docs:
        z, done = row(text), []
        for w in weights:
            done.append(float(predict(np.array([*map(logit, done), *z]), w)))
        scores.append((i, done[-1]))
    return scores


def test_toxicity_query_matches_brute_force(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet").collect() for t in ("documents", "labels"))
    want = dict(brute_toxicity([(r.doc_id, r.text) for r in docs], [(r.doc_id, r.toxic, r.quality) for r in labels]))
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, small).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i].score - want[i]) for i in want) < 1e-3
    assert all(got[i].toxic == int(got[i].score >= 0.5) for i in got)


def test_toxicity_labels_that_do_not_count(spark):
    """Labels outside 0 and 1, repeated labels, repeated rows and several texts of an id."""
    docs = [(i % 40, f"good {'bad' if i % 40 % 3 == 0 else 'fine'} word{i % 7}") for i in range(400)] + [(3, "a other text"), (50, None)]
    labels = [(i, int(i % 3 == 0), i % 2) for i in range(40)] + [(1, 1, 7), (2, 5, 1), (4, None, 0), (5, 1, 1), (None, 1, 1), (50, 0, None), (60, 1, 1)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, toxic string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    rows = {r.doc_id: (r.toxic, r.quality, r.text) for r in toxicity.learnable(d, lab).collect()}
    assert len(rows) == 41 and rows[5][:2] == (0, 1) and rows[3][2] == "a other text" and rows[50] == (0, 1, None)
    assert len(toxicity.learnable(d, lab, 7).collect()) == 7
    chain = toxicity.fit(d, lab)
    p = chain.probabilities([x for _, x in docs])[:, -1]
    assert max(abs(a - b) for a, (_, b) in zip(p, brute_toxicity(docs, labels), strict=True)) < 1e-3


def test_toxicity_of_odd_rows(spark):
    docs = frame(spark, odd_documents())
    labels = spark.createDataFrame([(4, 0, 1), (6, 1, 1), (7, None, 0), (8, 0, None), (9, 3, 1)], "doc_id long, toxic int, quality int")
    chain = toxicity.fit(docs, labels)
    p = chain.probabilities([None, "", "word"])
    assert p.shape == (3, 3) and ((p >= 0) & (p <= 1)).all()
    assert toxicity.fit(docs, labels.limit(0)).constant == 0.0
    kept = toxicity.clean_documents(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.clean_documents(frame(spark, []), labels).collect() == []


def test_later_links_see_out_of_fold_predictions():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=(600, 40)), np.ones(600)])
    noise = (rng.random((600, 2)) < 0.5).astype(float)  # nothing to learn: an in-fold fit would seem to know its labels
    weights = toxicity.fit_chain(x, noise[:, [0, 0]], np.arange(600) % toxicity.FOLDS)
    assert weights[1][0] < 1.0


@pytest.mark.parametrize("step", [1, 4, 8])
def test_folds_are_even_whatever_the_ids(step):
    """Ids of one residue are dealt to all folds, so that earlier categories feed later ones."""
    ids = np.arange(0, 400 * step, step)
    fold = toxicity.folds(ids)
    assert np.bincount(fold).tolist() == [100] * toxicity.FOLDS
    rng = np.random.default_rng(step)
    x = np.column_stack([rng.normal(size=(400, 3)), np.ones(400)])
    first = (x[:, 0] > 0).astype(float)
    weights = toxicity.fit_chain(x, np.column_stack([first, first]), fold)
    assert weights[1][0] > 0.5  # the first category's probability
    with pytest.raises(ValueError):
        toxicity.fit_chain(x, np.column_stack([first, first]), np.zeros(400, dtype=int))
    assert toxicity.folds(np.array([4, 8])).tolist() in ([0, 1], [1, 0])
