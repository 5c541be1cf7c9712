import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.llm import hard_negatives as hard
from tests.compare import same

SCHEMA = "id long, label int, vec array<long>"


def brute(rows, anchors, n=5, m=5):
    """Rows of the result, from rows ``id, label, vec`` of which equal ones count once."""
    rows = sorted({(i, y, tuple(v)) for i, y, v in rows if i is not None and y is not None and v is not None and None not in v})
    out = []
    for a in rows:
        if not anchors(a[0]):
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in rows if len(b[2]) == len(a[2])]
        positives = sorted((s, i) for s, i, y in scored if y == a[1] and i != a[0])[:n]
        others = sorted((s, i) for s, i, y in scored if y != a[1])
        for p, i in positives:
            inside = [(s, j) for s, j in others if 80 * -p <= 100 * -s <= 100 * -p][:m]
            out += [(a[0], i, k + 1, j, -p, -s) for k, (s, j) in enumerate(inside)]
    return sorted(out)


def found(spark, rows, schema=SCHEMA, step=10):
    df = spark.createDataFrame(rows, schema)
    return sorted(tuple(r) for r in hard.mine(df, F.col("id") % step == 0).collect())


def vectors(n, seed=1, size=12, near=False):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 30, (6, size))
    v = base[rng.integers(0, 6, n)] + rng.normal(0, 3, (n, size)) if near else rng.normal(0, 30, (n, size))
    return [(i, int(y), [int(x) for x in np.floor(r)]) for i, (r, y) in enumerate(zip(v, rng.integers(0, 4, n)))]


@pytest.mark.parametrize("near", [False, True])
def test_against_brute_force(spark, near):
    rows = vectors(900, near=near)
    expected = brute(rows, lambda i: i % 10 == 0)
    assert found(spark, rows) == expected
    assert len(expected) > 100


def test_ties_repeats_and_copies(spark):
    rng = random.Random(2)
    # few different vectors, so nearly all scores tie, and many copies of each
    rows = [(i, rng.randrange(3), [rng.randrange(1, 3) for _ in range(4)]) for i in range(400)]
    rows += rows[:50] + [(i, 1, [9, 9, 9, 9]) for i in range(1000, 1400)] + [(5, 2, [1, 1, 1, 1]), (10, 0, [7, 7, 7, 7])]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    rows = vectors(60) + [(None, 1, [1] * 12), (70, None, [1] * 12), (80, 1, None), (90, 1, [None] * 12), (100, 1, []), (110, 2, []), (101, 1, []), (120, 1, [5] * 3), (121, 1, [4] * 3), (122, 2, [4] * 3), (130, 9, [3] * 12)]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert found(spark, []) == []
    clashing = "id long, label int, vec array<long>, hash string, no long, copy string, block long"
    rows = [(*r, "h", 3, "c", 4) for r in vectors(60)]
    assert found(spark, rows, clashing) == brute([r[:3] for r in rows], lambda i: i % 10 == 0)


def test_numbers_beyond_double_precision(spark):
    big = 1 << 40
    rows = [(i, i % 2, [big + i, -big + i * i, 3]) for i in range(40)]
    expected = [(a, p, k, q, min(s, 2**63 - 1), min(t, 2**63 - 1)) for a, p, k, q, s, t in brute([(i, y, [x >> 12 for x in v]) for i, y, v in rows], lambda i: i % 10 == 0)]
    assert found(spark, [(i, y, [x >> 12 for x in v]) for i, y, v in rows]) == expected
    assert all(r[4] == r[5] == 2**63 - 1 for r in found(spark, rows))


def test_text_ids_and_labels(spark):
    rows = [(f"k{i:03d}", f"l{y}", v) for i, y, v in vectors(80)]
    df = spark.createDataFrame(rows, "id string, label string, vec array<long>")
    got = sorted(tuple(r) for r in hard.mine(df, F.col("id").endswith("0")).collect())
    assert got == brute(rows, lambda i: i.endswith("0"))


def test_bounds_hold_and_spare_most_rows():
    rows = np.array([v for _, _, v in vectors(5000, size=32)])
    index = hard.Approximations(rows)
    anchors = rows[:50]
    low, high = index.bounds(slice(None), anchors)
    scores = rows @ anchors.T
    assert (low <= scores).all() and (scores <= high).all()
    asked = []
    index.scores = lambda i, a, j, real=index.scores: asked.append(len(i)) or real(i, a, j)
    hard.nearest(index, np.arange(5000), anchors, np.arange(50), 5)
    assert sum(asked) < 0.05 * scores.size
    assert hard.Approximations(rows[:1]).bounds(slice(None), anchors)[0].shape == (1, 50)


def test_components_are_rounded_down_in_double_precision(spark):
    rows = [([0.1, -0.1, 1.0],), ([float("nan"), 1.0, 1.0],), ([None, 1.0, 1.0],), ([float("-inf"), 1.0, 1.0],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(hard.quantised("v")).collect()]
    assert got == [[25, -26, 256], None, None, None, None]


def test_the_query_gives_what_its_sql_gives(spark, sf_dir, duck):
    got = hard.op12_hard_negatives(spark, sf_dir).toPandas()
    same(got, duck.execute(hard.ORACLE_SQL).df())
    assert len(got)
