import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.llm import quality_rules, toxicity
from photolake.llm.samples import labelled_sample
from tests.llm import brute

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(np.asarray(score), kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    pos = np.asarray(label) == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_toxicity_on_held_out_rows(spark, labels):
    rows = toxicity.op5_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (brute.fold(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id].toxic) for r in rows if r.held_out and r.doc_id in labels]
    score, label = map(np.array, zip(*held))
    assert auc(score, label) > 0.9
    hit = (score >= 0.5) & (label == 1)
    assert hit.sum() / label.sum() > 0.75 and hit.sum() / max((score >= 0.5).sum(), 1) > 0.75


def test_quality_on_held_out_rows(spark, labels):
    rows = quality_rules.op6_quality_rules(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (brute.fold(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in labels]
    score, label = map(np.array, zip(*held))
    assert auc(score, label) > 0.9
    assert ((score >= 0.7) == label).mean() > 0.9


def tiny(spark):
    bad = "you are a horrid fool and a stupid pig"
    good = "the garden is green and the river runs to the sea"
    rows = [(i, f"{bad if i % 3 == 0 else good} {['one', 'two', 'six', 'ten'][i % 4]}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 != 0)) for i in range(200)], "doc_id long, toxic int, quality int")


def test_a_tiny_corpus_is_learned(spark):
    docs, marks = tiny(spark)
    model = toxicity.fit(docs, marks, F.lit(True))
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in toxicity.score(docs, model).collect())
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "score"] and all(r.doc_id % 3 for r in kept.collect())


def test_scores_do_not_depend_on_how_texts_are_cut(spark, monkeypatch):
    docs, marks = tiny(spark)
    model = toxicity.fit(docs, marks, F.lit(True))
    texts = ["a fool", "", None, "green " * 5000 + "stupid pig", "pig", "the river"] * 3
    whole = model.scores(texts)
    monkeypatch.setattr(toxicity, "RUN", 64)
    assert np.allclose(whole, model.scores(texts)) and np.allclose(whole, [model.scores([t])[0] for t in texts])


def test_a_toxic_passage_at_the_end_of_a_long_text_counts(spark):
    docs, marks = tiny(spark)
    model = toxicity.fit(docs, marks, F.lit(True))
    prose = "the garden is green and the river runs to the sea " * 20_000
    a, b = model.scores([prose, prose + "you are a horrid fool and a stupid pig"])
    assert a < 0.5 <= b


@pytest.mark.parametrize("kind", ["none", "one label"])
def test_without_labels(spark, kind):
    docs, marks = tiny(spark)
    marks = marks.limit(0) if kind == "none" else marks.where("toxic = 1")
    scores = {r.score for r in toxicity.score(docs, toxicity.fit(docs, marks, F.lit(True))).collect()}
    assert scores == {0.0}
    rated = {r.score for r in quality_rules.score(docs, quality_rules.fit(docs, marks, F.lit(True))).collect()}
    assert len(rated) == 1 and 0 <= rated.pop() <= 1


def test_odd_rows_are_scored(spark):
    docs, marks = tiny(spark)
    odd = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "x", 3), (2, "\u0000퟿ !", 4), (2, "\u0000퟿ !", 4)], "doc_id long, text string, score int")
    for module in (toxicity, quality_rules):
        rows = module.score(odd, module.fit(docs, marks, F.lit(True))).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 1}) == 1
        assert module.score(odd.limit(0), module.fit(docs, marks, F.lit(True))).count() == 0


def test_rules_in_columns_equal_rules_in_numpy(spark):
    docs, _ = tiny(spark)
    stats = quality_rules.statistics(docs).orderBy("doc_id").toPandas()
    rng = np.random.default_rng(1)
    x = stats[quality_rules._names()].to_numpy(np.float64)
    y = ((np.arange(len(x)) % 3 == 0) ^ (rng.random(len(x)) < 0.05)).astype(np.float64)
    model = quality_rules.train(x, y)
    z = np.full(len(x), model.start)
    at = {n: i for i, n in enumerate(quality_rules._names())}
    for conditions, weight in model.rules:
        z += weight * np.all([(x[:, at[c.name]] > c.cut) == c.above for c in conditions], axis=0)
    found = [r.score for r in quality_rules.score(docs, model).orderBy("doc_id").collect()]
    assert np.allclose(found, 1 / (1 + np.exp(-z)))
    assert model.rules
    holds = np.stack([quality_rules._holds(x, p) for p in quality_rules.tree_rules(x, y)], 1)
    used = [int((abs(quality_rules.lasso_logistic(holds, y, penalty)[1]) > 1e-6).sum()) for penalty in (0.0001, 0.05, 10.0)]
    assert used[0] >= used[1] >= used[2] == 0 < used[1]


def test_samples_are_bounded_and_the_same_each_time(spark):
    docs, marks = tiny(spark)
    twice = marks.unionByName(marks.withColumn("toxic", F.lit(1)).limit(5))
    a = labelled_sample(docs.unionByName(docs), twice, "toxic", F.col("doc_id") % 2 == 0, 40, 1500).orderBy("place").collect()
    b = labelled_sample(docs, twice, "toxic", F.col("doc_id") % 2 == 0, 40, 1500).orderBy("place").collect()
    assert a == b and len(a) <= 40 and sum(len(r.text) for r in a) <= 1500 and all(r.doc_id % 2 == 0 for r in a)


def test_long_texts_and_missing_documents_leave_the_sample_whole(spark):
    docs, marks = tiny(spark)
    want = labelled_sample(docs, marks, "toxic", F.lit(True), 200, 16_000).count()
    first = marks.orderBy(F.xxhash64("doc_id")).first().doc_id
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("long "), 20_000)).otherwise(F.col("text")))
    assert labelled_sample(long, marks, "toxic", F.lit(True), 200, 16_000).count() == want - 1 == 199
    gone = marks.unionByName(spark.createDataFrame([(i, 1, 0) for i in range(1000, 3000)], marks.schema))
    assert labelled_sample(docs, gone, "toxic", F.lit(True), 200, 16_000).count() == 200


def test_a_sample_without_a_label_that_there_is_fails(spark):
    docs, marks = tiny(spark)
    long = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("fool "), 1000)).otherwise(F.col("text")))
    with pytest.raises(ValueError, match="lacks a label"):
        toxicity.fit(long, marks, F.lit(True), max_bytes=16_000)


def test_all_labelled_documents_are_learned_from(spark):
    """A toxic word that only documents behind the first 12,000 hold, and one in texts of over 3 MB."""
    ids = spark.range(13_000).orderBy(F.xxhash64("id")).toPandas()["id"].tolist()
    rows = [(i, f"the garden number {k % 50} is green {'zorka' if k % 3 == 0 and k >= 12_000 else 'fine'}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    long = spark.range(100_000, 100_040).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("green garden "), 250_000), F.when(F.col("id") % 2 == 0, "blorka").otherwise("fine")).alias("text"))
    marks = docs.select("doc_id", F.col("text").contains("zorka").cast("int").alias("toxic")).unionByName(long.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic")))
    model = toxicity.fit(docs.unionByName(long), marks, F.lit(True))
    scores = model.scores(["the garden is green zorka", "the garden is green blorka", "the garden is green fine"])
    assert scores[0] >= 0.5 and scores[1] >= 0.5 > scores[2]


def test_shards_agree_and_the_model_is_the_same_each_time(spark, monkeypatch):
    docs, marks = tiny(spark)
    monkeypatch.setattr(toxicity, "EACH", 40)
    texts = [r.text for r in docs.collect()]
    one, two = (toxicity.fit(docs.repartition(n), marks, F.lit(True)).scores(texts) for n in (2, 3))
    assert (one == two).all() and all((s >= 0.5) == (i % 3 == 0) for i, s in enumerate(one))


def test_the_driver_holds_one_model_while_it_is_trained(spark, monkeypatch):
    docs, marks = tiny(spark)
    made, copy = [], toxicity.Fit.copy
    monkeypatch.setattr(toxicity.Fit, "copy", lambda self: made.append(1) or copy(self))
    model = toxicity.fit(docs, marks, F.lit(True))
    assert not made and all(r.predicted == (r.doc_id % 3 == 0) for r in toxicity.score(docs, model).collect())


def test_what_an_epoch_sends_stays_below_its_documents():
    """A shard sends up to 40 bytes for each of some 80,000 words, which were over half of what the check tool's larger table shuffled."""
    assert [toxicity.shards_of(n) for n in (0, 41_000, 205_175, 12_000_000, 10**9)] == [1, 1, 3, 183, 256]
    assert all(toxicity.shards_of(n) * 80_000 * 40 <= max(n, 65_536) * 50 for n in (10**5, 10**6, 10**7))


def test_thresholds_over_ranges_are_the_best_cuts(spark):
    rng = np.random.default_rng(3)
    z, y, kind = rng.normal(size=500).round(1), rng.random(500) < 0.3, rng.integers(0, 2, 500)
    rows = spark.createDataFrame([(int(k), float(v), int(x)) for k, v, x in zip(kind, z, y)], "kind int, z double, y int")
    found = toxicity.best_thresholds(rows.groupBy("kind", "z").agg(F.count("*").alias("n"), F.sum("y").alias("ones")))
    for k in (0, 1):
        f1 = lambda cut: 2 * (y & (z >= cut) & (kind == k)).sum() / (((z >= cut) & (kind == k)).sum() + (y & (kind == k)).sum())  # noqa: E731, B023
        assert found[k][1] == (y & (kind == k)).sum() and np.isclose(f1(found[k][0]), max(f1(c) for c in np.unique(z)))
