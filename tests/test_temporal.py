import random
from datetime import datetime, timedelta

import pytest

from photolake.operators import temporal

BEGIN = datetime(2024, 1, 1)
SCHEMA = "id long, who string, ts timestamp_ntz"


def rows(n, seed, keys, span, nulls=True):
    rng = random.Random(seed)
    out = [(i, rng.choice(keys), BEGIN + timedelta(seconds=rng.randrange(span))) for i in range(n)]
    return out + ([(n, None, BEGIN), (n + 1, keys[0], None), out[0]] if nulls else [])


def last(left, right, equal, tolerance):
    out = []
    for i, who, t in left:
        fits = [(u, j) for j, w, u in right if None not in (who, t, w, u) and w == who and (u <= t if equal else u < t)]
        u, j = max(fits, default=(None, None))
        out.append((i, j if j is not None and (tolerance is None or (t - u).total_seconds() <= tolerance) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("keys, equal, tolerance", [("a", True, None), ("abc", False, None), ("a" * 30 + "bcdefg", True, 40), ("ab", False, 3)])
def test_the_last_row_before(spark, keys, equal, tolerance):
    left, right = rows(300, 1, keys, 2000), rows(60, 2, keys, 2000)
    found = temporal.as_of(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "ts", "who", "id", tolerance, equal)
    got = sorted(((r.id, r.matched.id if r.matched else None) for r in found.collect()), key=str)
    assert got == last(left, right, equal, tolerance)


def test_a_match_is_carried_over_many_ranges(spark):
    """One key alone, whose only row on the right lies before all on the left."""
    left = [(i, "a", BEGIN + timedelta(seconds=i + 1)) for i in range(500)]
    right = [(7, "a", BEGIN), (8, "b", BEGIN)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = temporal.as_of(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "ts", "who", "id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.matched.id for r in found} == {7} and len(found) == 500


def test_empty_sides(spark):
    some, none = spark.createDataFrame(rows(5, 1, "a", 9), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert [r.matched for r in temporal.as_of(some, none, "ts", "who", "id").collect()] == [None] * 8
    assert temporal.as_of(none, some, "ts", "who", "id").count() == 0
    assert temporal.near_in_time(some, none, "ts", "who", 1, 1).count() == 0
    assert temporal.overlapping(none.withColumnRenamed("ts", "a").withColumnsRenamed({"who": "b"}).selectExpr("id", "a", "a as b"), none.selectExpr("id", "ts as a", "ts as b"), "a", "b").count() == 0


@pytest.mark.parametrize("before, after", [(0, 5), (30, 10), (0, 0)])
def test_rows_near_in_time(spark, before, after):
    left, right = rows(120, 3, "abc", 600), rows(120, 4, "abc", 600)
    found = temporal.near_in_time(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "ts", "who", before, after)
    got = sorted((r.l.id, r.r.id) for r in found.collect())
    assert got == sorted((i, j) for i, w, t in left for j, v, u in right if None not in (w, t, v, u) and w == v and -before <= (u - t).total_seconds() <= after)


def test_intervals_of_all_lengths(spark):
    rng = random.Random(5)

    def some(n):
        out = []
        for i in range(n):
            a = BEGIN + timedelta(seconds=rng.randrange(5000))
            out.append((i, rng.choice("ab"), a, a + timedelta(microseconds=rng.choice([0, 1, 10**6, 10**7, 10**8, 10**9]))))
        return out + [(n, None, BEGIN, BEGIN), (n + 1, "a", None, BEGIN), (n + 2, "a", BEGIN + timedelta(1), BEGIN)]

    schema = "id long, who string, a timestamp_ntz, b timestamp_ntz"
    left, right = some(150), some(150)
    for by in ("who", None):
        found = temporal.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "a", "b", by)
        got = sorted((r.l.id, r.r.id) for r in found.collect())
        real = lambda x: None not in x[2:] and x[2] <= x[3] and (by is None or x[1] is not None)  # noqa: E731, B023
        assert got == sorted((x[0], y[0]) for x in left for y in right if real(x) and real(y) and (by is None or x[1] == y[1]) and x[2] <= y[3] and y[2] <= x[3])


def test_how_many_of_others_an_interval_meets(spark):
    rng = random.Random(6)
    some = []
    for i in range(300):
        a = BEGIN + timedelta(seconds=rng.randrange(300))
        some.append((i, rng.choice("abc"), a, a + timedelta(seconds=rng.choice([0, 0, 1, 5, 40, 200]))))
    some += [(300, None, BEGIN, BEGIN), (301, "a", None, BEGIN), (302, "a", BEGIN + timedelta(1), BEGIN), some[0]]
    df = spark.createDataFrame(some, "id long, who string, a timestamp_ntz, b timestamp_ntz")
    real = [x for x in some if None not in x and x[2] <= x[3]]
    expected = sorted((x[0], sum(x[1] != y[1] and x[2] <= y[3] and y[2] <= x[3] for y in real)) for x in real)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "4", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted((r.id, r.met) for r in temporal.met_by_others(df, "a", "b", "who").collect()) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sessions_that_all_overlap_are_counted_without_their_pairs(spark, tmp_path):
    """30,000 sessions at one time are 900 million pairs."""
    from photolake.plans.registry import QUERIES

    spark.range(30_000).selectExpr("id as event_id", "timestamp'2024-01-01 00:00:00' as ts", "id as user_id").write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["overlapping_sessions"](spark, str(tmp_path))
    assert found.groupBy("met").count().collect() == [(29_999, 30_000)]
