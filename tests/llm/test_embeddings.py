import numpy as np
import pytest

from photolake.llm import nn_descent
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>"


def graph(rows, threshold=0.95):
    """``{vec_id: (n_links, component)}`` of rows with different ids."""
    good = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in good.items()}
    linked = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    root = brute.roots([i for i, _ in rows], linked)
    return {i: (sum(i in p for p in linked), root[i]) for i, _ in rows}


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], SCHEMA)
    out = nn_descent.near_duplicates(df, orders=4, **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return {r.vec_id: (r.n_links, r.component_id) for r in out}


def clouds(n, seed, dim=16, spread=0.2):
    """Vectors around a few centres, near enough for many links but not for all."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), dim))
    return [(int(i), (centres[rng.integers(len(centres))] + rng.normal(size=dim) * spread * rng.random()).tolist()) for i in range(n)]


def test_links_and_groups_against_brute_force(spark):
    rows = clouds(220, 1)
    real, got = graph(rows), found(spark, rows)
    assert sum(n for n, _ in real.values()) > 300
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in real.values())
    assert all(got[i][0] <= real[i][0] for i in real)
    assert sum(got[i][1] == real[i][1] for i in real) >= 0.99 * len(real)


def test_odd_vectors_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0, 0.5]
    rows = [(1, v), (2, v), (3, [2 * x for x in v]), (4, None), (5, [0.0] * 4), (6, [1.0, None, 2.0, 1.0]), (7, [float("nan"), 1.0, 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0, 1.0]), (9, []), (10, [1.0, 2.0]), (11, [-x for x in v])]
    assert found(spark, rows) == {1: (2, 1), 2: (2, 1), 3: (2, 1), **{i: (0, i) for i in range(4, 12)}}


def test_a_large_group_of_copies_counts_in_full(spark):
    rows = [(i, [0.3, 0.4, 0.5]) for i in range(2000)] + [(5000, [0.3, 0.4, 0.51]), (5001, [0.5, -0.4, 0.1])]
    got = found(spark, rows)
    assert got[7] == (2000, 0) and got[5000] == (2000, 0) and got[5001] == (0, 5001)


def test_a_dense_group_larger_than_a_block(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (np.array([1.0] + [0.0] * 7) + rng.normal(size=8) * 0.02).tolist()) for i in range(600)]
    got = found(spark, rows)
    assert all(got[i] == (599, 0) for i in range(600))


def test_two_dense_halves_of_one_group_are_joined(spark):
    rng = np.random.default_rng(6)
    sides = [np.array([1.0] + [0.0] * 15), np.array([1.0, 0.25] + [0.0] * 14)]
    rows = [(i, (sides[i % 2] + rng.normal(size=16) * 0.004).tolist()) for i in range(400)]
    assert set(graph(rows).values()) == {(399, 0)}
    assert set(found(spark, rows).values()) == {(399, 0)}


def test_two_halves_whose_lists_all_end_are_counted_exactly(spark):
    rng = np.random.default_rng(6)
    sides = [np.array([1.0] + [0.0] * 15), np.array([1.0, 0.25] + [0.0] * 14)]
    rows = [(i, (sides[i % 2] + rng.normal(size=16) * 0.004).tolist()) for i in range(300)]
    assert set(found(spark, rows, k_most=16).values()) == {(299, 0)}


def test_links_of_a_dense_group_come_from_the_graph(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(16)[0] + rng.normal(size=16) * 0.02).tolist()) for i in range(400)]
    seen = []
    audit = nn_descent.audit
    monkeypatch.setattr(nn_descent, "audit", lambda *a: seen.append(audit(*a)) or seen[-1])
    monkeypatch.setattr(nn_descent, "_counted", None)
    got = nn_descent.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.n_links for r in got) >= 0.9 * 400 * 399 and max(r.n_links for r in got) <= 399
    assert {r.component_id for r in got} == {0} and seen[-1] >= 0.9


def test_too_low_a_recall_is_an_error(spark):
    with pytest.raises(ValueError, match="the graph holds"):
        found(spark, clouds(150, 8), recall=2.0, wanted=2.0, tries=1)


def test_very_large_and_very_small_components(spark):
    rows = [(1, [1e200, 2e200, -1e200]), (2, [1.0, 2.0, -1.0]), (3, [1e-200, 2e-200, -1e-200]), (4, [1.0, -2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(df, orders=2, rounds=1).collect()}
    assert out == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def hot_and_pairs(hot, pairs, dim=32):
    """One dense group and pairs of vectors that are near each other alone."""
    rng = np.random.default_rng(9)
    rows = [np.eye(dim)[0] + rng.normal(size=dim) * 0.01 for _ in range(hot)]
    for _ in range(pairs):
        v, w = (x / np.sqrt((x * x).sum()) for x in rng.normal(size=(2, dim)))
        w -= (v @ w) * v
        rows += [v, 0.955 * v + np.sqrt(1 - 0.955**2) * w / np.sqrt((w * w).sum())]
    return [(i, v.tolist()) for i, v in enumerate(rows)]


def test_lone_pairs_are_found_beside_a_hot_group(spark):
    rows = hot_and_pairs(300, 300)
    assert found(spark, rows) == graph(rows)


def test_the_audit_sees_lone_pairs_beside_a_hot_group(spark):
    rows = hot_and_pairs(300, 60)
    packed = spark.createDataFrame([(i, 32, np.array(v, "<f4").tobytes()) for i, v in rows], "cid long, size int, vec binary")
    near = spark.createDataFrame([(i, 299) for i in range(300)], "cid long, near long")
    assert nn_descent.audit(near, packed, packed, "<f4", 0.95, 8, 512) == 0
    near = near.unionByName(spark.createDataFrame([(i, 1) for i in range(300, 360)], near.schema))
    assert abs(nn_descent.audit(near, packed, packed, "<f4", 0.95, 8, 512) - 0.5) < 0.01


def test_orders_follow_the_number_of_vectors():
    signs, orders = zip(*(nn_descent.spread_of_orders(n, 0.95, 64) for n in (0, 10_000, 1_000_000, 100_000_000)))
    assert list(signs) == sorted(signs) and 64 << signs[-1] >= 100_000_000
    assert orders[0] >= 8 and orders[1] < orders[2] < orders[3] < nn_descent.MOST_ORDERS


def test_repeated_rows_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [1.0, 0.01], 3), (None, [1.0, 0.0], 4)], "vec_id long, embedding array<float>, cid int")
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(df, orders=2, rounds=1).collect()), key=str)
    assert out == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False)]
    assert nn_descent.near_duplicates(df.limit(0), orders=2, rounds=1).count() == 0


def test_recall_over_the_supplied_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.op1_nn_descent(spark, sf_dir).collect()}
    real = graph(rows)
    total = sum(n for n, _ in real.values())
    assert set(got) == set(real) and sum(n for n, _ in got.values()) >= 0.9 * total
    assert all(got[i][0] <= real[i][0] for i in real)
