import random

import pytest
from pyspark.sql import functions as F

from photolake.llm import simhash
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def groups(spark, rows, schema=SCHEMA):
    return simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()


def near_texts(n, seed=1):
    """Texts in groups that differ in a word or two."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = rng.choices(vocabulary, k=rng.choice([1, 2, 5, 200, 300]))
        out.append(" ".join(w))
    return out


def test_all_documents_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, sf_dir).collect()}
    assert found == brute.simhash(docs)


def test_groups_against_brute_force(spark):
    rows = list(enumerate(near_texts(150)))
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in groups(spark, rows)}
    assert found == brute.simhash(rows)
    assert len({c for _, c in found.values()}) < len(rows)


@pytest.mark.parametrize("most, width", [(0, 4), (1, 2), (2, 1), (3, 1), (3, 2), (3, 4), (5, 2)])
def test_links_between_close_fingerprints(spark, most, width):
    rng = random.Random(most)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for k in range(1, 8):
            y = x
            for b in rng.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {frozenset((r.a, r.b)) for r in simhash.fingerprint_links(df, most, width).collect()}
    mask = (1 << 64) - 1
    real = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & mask).count("1") <= most}
    assert found == real
    assert simhash.fingerprint_links(df, most, width).count() == len(found)


def test_the_distance_of_bit_counts_is_a_lower_bound(spark):
    rng = random.Random(9)
    rows = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long")
    for width in (1, 2, 4):
        bound = simhash.manhattan(simhash.segment_counts(F.col("a"), width), simhash.segment_counts(F.col("b"), width), width, 0, 64 // width)
        for r in df.select("a", "b", bound.alias("d")).collect():
            counts = lambda x: [bin(x >> width * i & (1 << width) - 1).count("1") for i in range(64 // width)]  # noqa: E731, B023
            assert r.d == sum(abs(x - y) for x, y in zip(counts(r.a), counts(r.b))) <= bin(r.a ^ r.b).count("1")


def test_the_grid_follows_the_number_of_points():
    widths = [simhash.segment_width(10**k) for k in range(12)]
    assert widths == sorted(widths, reverse=True) and set(widths) == {1, 2, 4}


def test_empty_null_and_repeated_rows(spark):
    rows = [(4, None), (2, ""), (3, " \n\t "), (9, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "A B  C\td"), (None, "quite another text here")]
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in groups(spark, rows)), key=str)
    assert [(i, c) for i, f, c in found if f == "0" * 16] == [(2, 2), (3, 2), (4, 2)]
    assert [c for i, f, c in found if f == brute.simhash([(0, "a b c d")])[0][0]] == [7, 7, 7, 7]
    assert (None, f"{brute.fingerprint('quite another text here'):016x}", None) in found
    assert groups(spark, []) == []


def test_one_of_each_group_stays_with_all_columns(spark):
    schema = "doc_id long, text string, id string, hash string, fp long"
    rows = [(1, "x y z x", "a", "b", 1), (2, "x y z x", "c", "d", 2), (3, None, "e", None, 3), (4, "", "g", "h", 4), (5, "other words stand here", None, None, None), (5, "other words stand here", None, None, None)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "id", "hash", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]
    assert simhash.one_of_each(spark.createDataFrame([], schema)).count() == 0


def test_a_large_group_of_copies_and_a_very_long_text(spark):
    long = " ".join(f"t{i % 977}" for i in range(120_000))
    rows = [(i, "the same words in every one of these") for i in range(3000)] + [(5000, long), (5001, long + " end")]
    found = {r.doc_id: r.component_id for r in groups(spark, rows)}
    assert all(found[i] == 0 for i in range(3000))
    assert found[5001] == 5000
