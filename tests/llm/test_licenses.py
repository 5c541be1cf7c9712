import random

import pytest
from pyspark.sql import functions as F

from photolake.llm import license_scan as L
from tests.compare import same
from tests.llm import brute


def digest(spark, rows):
    """op4's columns over given rows, through the operator."""
    docs, spans = L.find_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    return docs, spans


def test_all_documents_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = L.op4_license_scan(spark, sf_dir).collect()
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows}
    assert found == {i: tuple(x) for i, *x in brute.phrases(docs, L.PHRASES)}
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_the_query_against_its_sql(spark, sf_dir, duck):
    same(L.op4_license_scan(spark, sf_dir).toPandas(), duck.execute(L.ORACLE_SQL).df())


def test_grams_with_a_template_s_hash_and_other_words_do_not_vote(spark):
    rows, texts = L.template_grams([("x", "one two three four")], {}, 3)
    assert [r[4] for r in rows] == [0, 1] and set(texts.values()) == {b"one two three", b"two three four"}
    df = spark.createDataFrame([(1, "one two three", 5)], "doc_id long, text string, text_hash long")
    wrong = dict.fromkeys(texts, b"other words here")
    assert [r.grams for r in L._scanned(df, 3, wrong).collect()] == [[0]]
    assert [r.grams for r in L._scanned(df, 3, texts).collect()] == [[rows[0][0]]]


def test_whole_license_texts(spark):
    long = [(i, "before " + t + " after") for i, (label, t) in enumerate(L.TEMPLATES) if len(t) > 400]
    _, spans = digest(spark, long)
    best = {}
    for r in spans.where("not is_phrase and coverage = 1").collect():
        best.setdefault(r.doc_id, set()).add(r.label)
    assert {i: {L.TEMPLATES[i][0]} for i, _ in long} == best


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [*"under the mit license apache version 2 cc by nc".split(), "UNDER THE MIT License,", "Apache License - Version 2.", "CC BY-NC", "word"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 30)))) for i in range(80)]
    _, spans = digest(spark, rows)
    found = spans.where("is_phrase").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("first_word").alias("a"), F.max("first_word").alias("b")).collect()
    expected = {i: (n, a, b) for i, _, n, a, b, _ in brute.phrases(rows, L.PHRASES) if n}
    assert {r.doc_id: (r.n, r.a, r.b) for r in found} == expected


def test_altered_notices_are_found_and_prose_is_not(spark):
    changed = "x y z This program is free software you may redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation q"
    rows = [(1, changed), (2, "the license of the bus driver is under the seat"), (3, "Permission is granted to copy"), (4, L.TEMPLATES[0][1] + " and so on")]
    _, spans = digest(spark, rows)
    found = {(r.doc_id, r.label): r for r in spans.where("not is_phrase").collect()}
    assert set(found) == {(1, "gpl-3"), (4, "mit")}
    assert found[1, "gpl-3"].coverage < 1 and found[1, "gpl-3"].first_word == 3
    assert found[4, "mit"].coverage == 1 and (found[4, "mit"].first_word, found[4, "mit"].last_word) == (0, len(brute.words(L.TEMPLATES[0][1])) - 1)


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    long = "cc by nc " * 40_000
    rows = [(1, None), (2, ""), (3, "under the MIT license"), (3, "under the MIT license"), (None, "cc by nc"), (4, long)]
    docs, spans = digest(spark, rows)
    assert docs.count() == 6
    assert spans.where("doc_id = 3 and is_phrase").count() == 1 and spans.where("doc_id is null and is_phrase").count() == 1
    assert spans.where("doc_id = 4 and is_phrase").count() == 40_000
    docs, spans = digest(spark, [])
    assert docs.count() == spans.count() == 0


def test_the_query_gives_a_row_for_each_row(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 5), (3, "under the MIT license", 6), (3, "under the MIT license", 7), (None, "cc by nc", None)], "doc_id long, text string, gram long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(((r.doc_id, r.n_base, r.labels) for r in L.op4_license_scan(spark, str(tmp_path)).collect()), key=str)
    assert found == sorted([(1, 0, ""), (3, 1, "mit"), (3, 1, "mit"), (None, 1, "cc-by-nc")], key=str)
