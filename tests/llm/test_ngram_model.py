import math
import random

import pytest
from pyspark.sql import functions as F

from photolake.llm import ngram_model
from photolake.llm.tables import fold
from tests.llm import brute


def scored(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return ngram_model.score(df, fold("doc_id") % 7 == 2, **options).collect()


def chains(n=120, seed=2):
    """Texts in which a word tells much of the next."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w, k = [rng.randrange(40)], rng.randint(0, 60)
        for _ in range(k):
            w.append((w[-1] * 7 + rng.choice([1, 1, 1, 2, 5])) % 40)
        out.append((i, " ".join(f"T{x}" for x in w[:k])))
    return out


def test_base_of_all_documents_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = brute.unigrams(docs)
    rows = ngram_model.op7_ngram_model(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        held, n, known, total, base = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert -math.inf < r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("options", [{}, {"block_words": 50, "bucket_grams": 30}])
def test_how_the_rows_are_cut_changes_nothing(spark, options):
    rows = chains()
    a = {r.doc_id: r for r in scored(spark, rows)}
    b = {r.doc_id: r for r in scored(spark, rows[::-1], **options)}
    for i, _ in rows:
        assert a[i][:5] == b[i][:5] and a[i].score == pytest.approx(b[i].score, abs=1e-6)


def test_scores_against_brute_force(spark):
    rows = chains(300, 4) + [(1000, None), (1001, ""), (1002, "never seen before t1 t2")]
    expected = brute.interpolated(rows)
    found = {r.doc_id: r.score for r in scored(spark, rows)}
    assert found == pytest.approx(expected, rel=1e-6)


def test_scores_against_counts(spark):
    """The model's probabilities lie between the estimates that it mixes, and beat either on new texts."""
    rows = chains(400)
    found = {r.doc_id: r for r in scored(spark, rows)}
    expected = brute.unigrams(rows)
    held = [i for i, _ in rows if expected[i][0]]
    assert sum(found[i].score for i in held) > sum(expected[i][4] for i in held) * 0.7
    assert all(r.base_score == pytest.approx(expected[i][4], abs=1e-9) for i, r in found.items())


def test_next_tokens_have_a_probability_of_one_together(spark):
    """Every learned token, and one that stands for all unknown, after the same context."""
    rows = chains(60, 3)
    vocabulary = sorted({w for i, t in rows if brute.fold(i) % 7 != 2 for w in brute.words(t, brute.NO_SPACE)})
    tests = [i for i in range(1000, 9000) if brute.fold(i) % 7 == 2][: len(vocabulary) + 2]
    context = vocabulary[3]
    extra = [(tests[0], context)] + [(i, f"{context} {w}") for i, w in zip(tests[1:], [*vocabulary, "never-seen"])]
    found = {r.doc_id: r.score for r in scored(spark, rows + extra)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.count() == 60
    # p(context w end) / p(end | w) needs the end's probability after w; compare it through texts that end there
    total = 0.0
    for (i, t), w in zip(extra[1:], [*vocabulary, "never-seen"]):
        total += 10 ** found[i]
    assert total + 10 ** found[tests[0]] <= 1.0


def test_weights_learn_which_estimate_is_right():
    cells = ngram_model.CELLS
    sure = [(5, cells // 2 - 8, cells // 2 + 20, 1000), (0, cells // 2 + 4, 0, 50)]
    w = ngram_model.fit_weights(sure)
    assert w[5][2] > 0.9 and w[0][2] == 0
    assert (abs(w.sum(1) - 1) < 1e-9).all() and (w[:, :2] > 0).all()
    assert (abs(ngram_model.fit_weights([]).sum(1) - 1) < 1e-9).all()


def test_nulls_repeats_long_texts_and_nothing(spark):
    rows = [(1, None), (2, ""), (3, "a B a"), (3, "a B a"), (None, "a"), (5, "a b " * 100_000)]
    found = sorted(scored(spark, rows), key=lambda r: (str(r.doc_id), r.n_tokens))
    assert [(str(r.doc_id), r.n_tokens) for r in found] == [("1", 1), ("2", 1), ("3", 4), ("3", 4), ("5", 200_001), ("None", 2)]
    assert all(math.isfinite(r.score) for r in found)
    assert scored(spark, []) == []


def test_other_columns_do_no_harm(spark):
    df = spark.createDataFrame([(1, "a b", 1, 2)], "doc_id long, text string, block int, held_out int")
    assert ngram_model.score(df, F.lit(False)).count() == 1
