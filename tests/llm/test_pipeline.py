import corpus_pipeline
import pytest
from cases import frame, odd_documents
from pyspark.sql import functions as F

from loomspark.llm import jaccard_join, mixing, packing, quality, toxicity


def test_stages_against_their_parts(spark):
    """Each stage on what the one before kept, held against a plain version of it."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    chain = toxicity.fit(docs, labels)
    p = chain.probabilities([r.text for r in rows.values()])[:, -1]
    kept = [i for i, x in zip(rows, p, strict=True) if x < 0.5]
    now = spark.createDataFrame([rows[i] for i in kept], docs.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.toxic(spark, docs, folder).collect()) == sorted(kept)

    model = quality.fit(quality.with_statistics(now), quality.learnable(labels))
    kept = [i for i in kept if model.score([quality.statistics(rows[i].text)] @ __import__("numpy").eye(len(quality.NAMES)))[0] >= 0.5]
    assert sorted(r.doc_id for r in corpus_pipeline.good(spark, now, folder).collect()) == sorted(kept)
    now = spark.createDataFrame([rows[i] for i in kept], docs.schema)

    component = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(now).collect()}
    kept = [i for i in kept if component[i] == i]
    single = corpus_pipeline.deduplicate(spark, now, folder)
    assert sorted(r.doc_id for r in single.collect()) == sorted(kept) and single.columns == docs.columns
    now = spark.createDataFrame([rows[i] for i in kept], docs.schema)

    mixed = corpus_pipeline.mixture(spark, now, folder)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in mixing.mix(now, corpus_pipeline.MIX_SHARE, 1).collect())
    ids = packing.Ids(packing.default_vocabulary())
    total = sum(len(ids.of(r.text)) // 4 + 1 for r in mixed.collect())
    assert sum(r.length for r in corpus_pipeline.packed(spark, mixed, folder).collect()) == total


def test_run_is_the_stages_in_a_row(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((made := stage(spark, docs, small)).collect(), made.schema)
    a, b = (sorted((r.doc_id, r.length) for r in x.groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "length").collect()) for x in (docs, corpus_pipeline.run(spark, small)))
    assert a == b and a


def test_one_row_of_each_component_stays(spark):
    """Repeated rows, ids with two texts, and rows without an id that copy others."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(5, a), (5, a), (5, b), (7, b), (9, c), (8, c), (8, c), (None, c.upper()), (None, d), (None, d), (None, d + " more"), (3, "z"), (4, None), (4, "")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, docs, "").collect()), key=repr)
    alone = [r for r in got if r[0] is None]
    assert [r for r in got if r[0] is not None] == [(3, "z"), (4, ""), (5, a), (8, c)]
    assert len(alone) == 1 and alone[0][1] in (d, d + " more")


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, small, stage):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    assert stage(spark, docs, small).collect() == []


def test_stages_take_odd_rows(spark, small):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names go through every stage."""
    docs = frame(spark, odd_documents()).repartition(3)
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, small)
        assert made.columns == docs.columns
        got = [(r.doc_id, r.text) for r in made.collect()]
        assert set(got) <= rows, name
        if name == "jaccard_join":
            assert sorted(i for i, _ in got if i is not None) == [1, 2, 3, 4, 7, 8, 10] and sum(i is None for i, _ in got) == 1
    ids = packing.Ids(packing.default_vocabulary())
    want = sum(len(ids.of(r.text)) // 4 + 1 for r in docs.collect())
    assert sum(r.length for r in corpus_pipeline.packed(spark, docs, small).collect()) == want


def test_stages_keep_columns_of_any_name(spark, small):
    """Columns named like those that stages use themselves come through unchanged."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = ["domain", "tokens", "epoch", "take_tokens", "_document", "a.b", "component_id", "first", "n"]
    wide = docs.select("*", *[(F.col("doc_id") * 10 + k).alias(c) for k, c in enumerate(names)])
    wide = wide.union(wide.filter("doc_id < 5")).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, wide, small)
        assert made.columns == wide.columns, name
        rows = made.collect()
        assert rows and all(r[c] == r["doc_id"] * 10 + k for r in rows for k, c in enumerate(names)), name
