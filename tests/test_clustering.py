"""DBSCAN, components and suppression against plain sequential versions."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from photolake.operators import clustering, components, detection


def sequential(points: np.ndarray, eps: float, least: int) -> list:
    """Clusters opened in order of the points, each expanded before the next."""
    near = [[j for j in range(len(points)) if ((points[i] - points[j]) ** 2).sum() <= eps * eps] for i in range(len(points))]
    label, n = [None] * len(points), 0
    for i in range(len(points)):
        if label[i] is not None or len(near[i]) < least:
            continue
        queue, label[i] = [i], n
        while queue:
            for j in near[queue.pop()]:
                if label[j] is None:
                    label[j] = n
                    if len(near[j]) >= least:
                        queue.append(j)
        n += 1
    return label


def labels(spark, points, eps, least):
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "ord long, embedding array<float>")
    return [r.cluster_id for r in clustering.dbscan(df, eps, least).orderBy("ord").collect()]


@pytest.mark.parametrize(
    "points, eps, least, expected",
    [
        ([], 1.0, 3, []),
        ([[2, 2, 2, 2]], 1.0, 2, [None]),
        ([[5, 5]] * 3 + [[5, 6]], 1.0, 4, [0, 0, 0, 0]),
        # a chain whose ends are border points, a point that is shared by two cores, and noise
        ([[0, 0], [0, 3], [0, 6], [0, 9], [0, 40]], 3.0, 3, [0, 0, 0, 0, None]),
        ([[0, 0], [1, 0], [-1, 0], [3, 0], [5, 0], [6, 0], [7, 0]], 2.0, 4, [0, 0, 0, 0, 1, 1, 1]),
    ],
)
def test_known_clusters(spark, points, eps, least, expected):
    assert labels(spark, points, eps, least) == expected
    assert expected == sequential(np.array(points, float), eps, least)


def test_groups_of_vectors_do_not_change_the_clusters(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(60, 3)), np.repeat(rng.normal(size=(3, 3)), 20, 0)]).astype(np.float32)
    expected = sequential(points.astype(np.float64), 0.7, 4)
    monkeypatch.setattr(clustering, "TILE", 7)
    assert labels(spark, points, 0.7, 4) == expected


def test_pairs_within_reach(spark):
    points = np.random.default_rng(2).normal(size=(80, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(90, None), (91, []), (92, [1.0])], "ord long, embedding array<float>")
    found = {(r.a, r.b): r.d2 for r in clustering.neighbours(df, 0.8).collect()}
    p = points.astype(np.float64)
    real = {(i, j): ((p[i] - p[j]) ** 2).sum() for i in range(80) for j in range(i + 1, 80) if ((p[i] - p[j]) ** 2).sum() <= 0.64}
    assert set(found) == set(real) and all(abs(found[k] - real[k]) < 1e-12 for k in real)
    lone = clustering.dbscan(df, 0.8, 2).where("ord >= 90").orderBy("ord").collect()
    assert [(r.degree, r.cluster_id) for r in lone] == [(1, None)] * 3


@pytest.mark.parametrize("seed, eps, least", [(1, 0.6, 2), (2, 0.8, 4), (3, 0.5, 3)])
def test_clusters_equal_the_sequential_ones(spark, seed, eps, least):
    points = np.random.default_rng(seed).normal(size=(70, 2)).astype(np.float32)
    assert labels(spark, points, eps, least) == sequential(points.astype(np.float64), eps, least)


def test_components_of_a_long_path_and_odd_links(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (None, 3), (60, 0)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61))
    assert (found[100], found[200], found[201]) == (100, 200, 200)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def boxes_of(spark, boxes):
    rows = [(1, i, *map(float, b)) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, "photo long, face_ord int, x1 double, y1 double, x2 double, y2 double, confidence double")


def test_suppression_keeps_the_surest(spark):
    kept = detection.suppressed(boxes_of(spark, [(0, 0, 10, 10, 0.9), (1, 1, 11, 11, 0.5), (50, 50, 60, 60, 0.8)]), "photo", 0.4)
    assert [r.confidence for r in kept.orderBy(F.desc("confidence")).collect()] == [0.9, 0.8]


def overlap(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return w / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w + 1e-6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20), st.integers(5, 20), st.integers(5, 20), st.integers(0, 4)), min_size=1, max_size=25))
def test_kept_boxes_are_apart_and_dropped_ones_are_not(spark, drawn):
    boxes = [(x, y, x + w, y + h, c / 4) for x, y, w, h, c in drawn]
    order = sorted(range(len(boxes)), key=lambda i: (-boxes[i][4], i))
    expected = []
    for i in order:
        if all(overlap(boxes[i], boxes[k]) <= 0.4 for k in expected):
            expected.append(i)
    kept = detection.suppressed(boxes_of(spark, boxes), "photo", 0.4)
    assert sorted(r.face_ord for r in kept.collect()) == sorted(expected)


@pytest.mark.parametrize("a, b, expected", [((0, 0, 10, 10), (0, 0, 10, 10), 1), ((0, 0, 10, 10), (20, 20, 30, 30), 0), ((0, 0, 10, 10), (5, 5, 15, 15), 25 / 175)])
def test_overlap_of_two_boxes(spark, a, b, expected):
    from photolake.functions.geometry import iou

    box = lambda x: F.struct(*(F.lit(float(v)).alias(c) for v, c in zip(x, ("x1", "y1", "x2", "y2"))))
    assert spark.range(1).select(iou(box(a), box(b)).alias("x")).first().x == pytest.approx(expected, abs=1e-6)


def test_transforms(spark):
    from photolake.functions.geometry import inverse_similarity
    from photolake.operators.models import TEMPLATE

    rows = [(0, [(*p, *p) for p in TEMPLATE]), (1, [(10 + 2 * y, 5 - 2 * x, x, y) for x, y in TEMPLATE]), (2, [(1.0, 1.0, *p) for p in TEMPLATE])]
    df = spark.createDataFrame(rows, "i int, pairs array<struct<x:double,y:double,u:double,v:double>>")
    found = detection.aligned(df, "pairs")
    found = found.withColumns(inverse_similarity(*(F.col(c) for c in ("a", "b", "tx", "ty")))).orderBy("i").collect()
    assert (found[0].a, found[0].b, found[0].tx, found[0].ty) == pytest.approx((1, 0, 0, 0), abs=1e-6)
    m = lambda a, b, x, y: np.array([[a, -b, x], [b, a, y], [0, 0, 1]])
    f, i = m(found[1].a, found[1].b, found[1].tx, found[1].ty), m(found[1].ia, found[1].ib, found[1].itx, found[1].ity)
    assert np.allclose(f @ i, np.eye(3), atol=1e-6)
    assert found[2].a is None


def clustered(n, groups=40, size=32, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return centres[rng.integers(0, groups, n)] + rng.normal(0, 0.03, (n, size))


def test_most_pairs_of_groups_are_left_out_where_vectors_lie_in_clusters(spark, monkeypatch):
    # as dear as if there were many more vectors
    monkeypatch.setattr(clustering, "PAIR_S", 1e-5)
    x = clustered(4000)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "ord long, embedding array<double>")
    assert clustering.share_met(df, 0.75) < 0.1
    found = {frozenset((r.a, r.b)) for r in clustering.neighbours(df, 0.22).collect()}
    d2 = (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T
    i, j = np.nonzero(np.triu(d2 <= 0.22 * 0.22, 1))
    assert found == {frozenset(p) for p in zip(i.tolist(), j.tolist())} and len(found) > 1000


def test_groups_that_are_cut_and_spans_compared_in_blocks(spark, monkeypatch):
    """One hot cluster of many tiles, other lengths, and vectors without distances."""
    monkeypatch.setattr(clustering, "TILE", 50)
    monkeypatch.setattr(clustering, "SPANS", 4)
    monkeypatch.setattr(clustering, "PIVOTS", 9)
    x = [[float(a) for a in v] for v in np.vstack([clustered(300, 1), clustered(200, 5)])] + [[1.0, 2.0], [1.0, 2.1], [float("nan")] * 32, [float("inf")] * 32]
    df = spark.createDataFrame(list(enumerate(x)), "ord long, embedding array<double>")
    found = sorted((r.a, r.b) for r in clustering.neighbours(df, 0.2).collect())
    near = lambda v, w: len(v) == len(w) and sum((a - b) ** 2 for a, b in zip(v, w)) <= 0.04
    assert found == [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if near(x[i], x[j])]


def test_a_vector_is_sent_to_few_groups_however_many_there_are(spark, monkeypatch):
    """Groups grow with the table up to a bound, and are compared tile by tile within the task."""
    monkeypatch.setattr(clustering, "TILE", 5)
    x = np.random.default_rng(8).normal(size=(600, 8))
    x[:40] = x[0] + np.random.default_rng(9).normal(size=(40, 8)) / 50
    df = spark.createDataFrame(list(enumerate(x.tolist())), "ord long, embedding array<double>")
    packed = clustering._packed(df.selectExpr("ord as cid", "1L as n", "embedding"))
    assert clustering._tiles(*clustering._grouped(packed, 1.5)).count() <= 600 * 2 * clustering.GROUPS
    assert labels(spark, x, 1.5, 4) == sequential(x, 1.5, 4)
    assert clustering.group_rows(600_000, np.ones((1, 64))) == 32_768 and clustering.group_rows(600_000, np.ones((1, 1024))) == 2048


def packed_tile(x: np.ndarray, kind: str):
    """A tile of one group as its task gets it."""
    n = len(x)
    columns = [pa.array([0] * n), pa.array([0] * n), pa.array([False] * n), pa.array(range(n), pa.int64()), pa.array([1] * n), pa.array([x.shape[1]] * n, pa.int32()), pa.array([v.astype(kind).tobytes() for v in x], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["one", "two", "second", "cid", "n", "size", "vec"])


def test_a_full_tile_takes_little_memory_even_where_all_are_near(spark):
    """4,096 equal vectors: no square of the group is held in numbers, and no list of its pairs."""
    x = np.ones((clustering.TILE, 64), np.float32)
    tracemalloc.start()
    try:
        counted = list(clustering._counted(1.0)(iter([packed_tile(x, "<f4")])))
        assert set(counted[0].column("k").to_pylist()) == {clustering.TILE - 1}
        assert tracemalloc.get_traced_memory()[1] < 60e6
        tracemalloc.reset_peak()
        d2 = [clustering._squared(x[:512].astype(float), x.astype(float), *(i.ravel() for i in np.indices((512, len(x)))))]
        assert d2[0].max() == 0 and tracemalloc.get_traced_memory()[1] < 150e6
        tracemalloc.reset_peak()
        far = [b for b, d in clustering._slices(iter([packed_tile(x, "<f4")] * 2), np.eye(64).repeat(8, 0))]
        assert sum(b.num_rows for b in far) == 2 * len(x)
    finally:
        tracemalloc.stop()


def test_vectors_are_packed_as_floats_only_where_these_hold_them(spark):
    rows = [(0, [0.5, 1.0]), (1, [0.1, 1.0]), (2, [float("nan"), 1.0]), (3, [1e300, 1.0]), (4, [float("inf"), -0.0])]
    df = spark.createDataFrame(rows, "cid long, embedding array<double>").selectExpr("cid", "1L as n", "embedding")
    got = {r.cid: (len(r.vec), clustering._matrix([r.vec], r["size"])[0].tolist()) for r in clustering._packed(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 8, 1: 16, 2: 16, 3: 16, 4: 8}
    assert all(np.array_equal(got[i][1], v, equal_nan=True) for i, v in rows)
    # floats of 32 parts are as many bytes as doubles of 16
    mixed = [(i, [float(i)] * n) for i, n in enumerate([32, 16, 32, 16])] + [(4, [0.1] * 16)]
    df = spark.createDataFrame(mixed, "ord long, embedding array<double>")
    assert sorted((r.a, r.b) for r in clustering.neighbours(df, 20.0).collect()) == [(0, 2), (1, 3), (1, 4), (3, 4)]


def test_near_vectors_far_from_the_origin(spark):
    """Their squares are so large that what is left of a difference is rounding."""
    x = np.random.default_rng(4).normal(size=(60, 3)) + 1e6
    df = spark.createDataFrame(list(enumerate(x.tolist())), "ord long, embedding array<double>")
    found = sorted((r.a, r.b) for r in clustering.neighbours(df, 0.5).collect())
    assert found == [(i, j) for i in range(60) for j in range(i + 1, 60) if ((x[i] - x[j]) ** 2).sum() <= 0.25]


def test_both_sides_of_a_pair_of_groups_stay_in_the_memory_they_came_in():
    n = 5000
    rows = {"one": [0] * 2 * n, "two": [1] * 2 * n, "second": [False] * n + [True] * n, "cid": list(range(2 * n)), "n": [1] * 2 * n, "size": [64] * 2 * n, "vec": [np.full(64, i % 7, "<f4").tobytes() for i in range(2 * n)]}
    types = [("one", pa.int64()), ("two", pa.int64()), ("second", pa.bool_()), ("cid", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("vec", pa.binary())]
    batch = pa.RecordBatch.from_pydict(rows, pa.schema(types))
    before, most, pairs = pa.total_allocated_bytes(), 0, 0
    for same, p, q, x, y in clustering._met(iter([batch.slice(0, 7000), batch.slice(7000)])):
        most, pairs = max(most, pa.total_allocated_bytes() - before), pairs + len(x) * len(y)
        assert not same and max(p.column("cid").to_pylist()) < n <= min(q.column("cid").to_pylist())
    assert pairs == n * n
    assert most < batch.nbytes // 4
