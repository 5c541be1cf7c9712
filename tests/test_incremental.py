import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.operators import clustering, incremental
from photolake.sources.projects import Store
from photolake.streaming.people import grouped_stream

SCHEMA = "ord long, embedding array<double>"


def as_rows(df):
    return sorted((r.ord, r.degree, r.cluster_id) for r in df.collect())


def points(n, seed, size=6):
    """Vectors in clusters, some of them apart, bridges between, copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 2, (8, size))
    x = centres[rng.integers(0, 8, n)] + rng.normal(0, 0.25, (n, size))
    x[: n // 8] = rng.normal(0, 2, (n // 8, size))
    x[n // 2 : n // 2 + 10] = x[0]
    steps = np.linspace(0, 1, 12)[:, None]
    x[-12:] = centres[0] * (1 - steps) + centres[1] * steps
    return x.tolist()


@pytest.mark.parametrize("seed, eps, least, cuts", [(1, 0.8, 4, 3)])
def test_after_each_batch_as_if_all_had_come_at_once(spark, seed, eps, least, cuts):
    rows = list(enumerate(points(240, seed)))
    # ids of later batches lie between those of earlier ones
    batches = [rows[i::cuts] for i in range(cuts)]
    g, seen = incremental.empty(spark, eps, least), []
    for batch in batches:
        g = incremental.added(g, spark.createDataFrame(batch, SCHEMA))
        seen += batch
        assert as_rows(incremental.labels(g)) == as_rows(clustering.dbscan(spark.createDataFrame(seen, SCHEMA), eps, least))


def test_only_groups_with_something_new_are_compared(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 10, (20, 4))
    rows = [(i, (centres[i % 20] + rng.normal(0, 0.1, 4)).tolist()) for i in range(400)]
    g = incremental.added(incremental.empty(spark, 0.5, 3), spark.createDataFrame(rows, SCHEMA))
    new = incremental.added(g, spark.createDataFrame([(1000, centres[3].tolist())], SCHEMA))
    spans = g.spans.withColumn("fresh", F.lit(False)).unionByName(new.spans.join(g.spans, "group", "left_anti").withColumn("fresh", F.lit(True)))
    assert clustering.meeting(spans, 0.5).count() <= 3 < g.spans.count()
    before = {r.ord: r.cluster_id for r in incremental.labels(g).collect()}
    now = {r.ord: (r.degree, r.cluster_id) for r in incremental.labels(new).collect()}
    assert now[1000] == (21, before[3]) and {i: c for i, (_, c) in now.items() if i != 1000} == before


def test_repeated_odd_and_missing_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.1]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [1.05]), (1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    g = incremental.added(incremental.empty(spark, 0.5, 2), df)
    assert as_rows(incremental.labels(g)) == as_rows(clustering.dbscan(df.dropDuplicates(["ord"]), 0.5, 2))
    again = incremental.added(g, df)
    assert as_rows(incremental.labels(again)) == as_rows(incremental.labels(g))
    none = incremental.added(incremental.empty(spark, 0.5, 2), df.where("false"))
    assert as_rows(incremental.labels(none)) == []


def test_a_stream_of_faces_and_a_batch_that_fails(spark, tmp_path):
    rows = list(enumerate(points(90, 7)))
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    store = Store(spark, f"file://{tmp_path}/store")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    told, check = [], str(tmp_path / "check")

    def tell(number, found):
        told.append((number, found.count()))
        if len(told) == 2:
            raise RuntimeError("the second batch breaks off behind its work")

    query = grouped_stream(stream(), store, "faces", 0.8, 4, check, tell)
    with pytest.raises(Exception):
        query.awaitTermination(300)
        raise query.exception() or RuntimeError("no failure")
    grouped_stream(stream(), store, "faces", 0.8, 4, check, tell).awaitTermination(300)
    assert [n for n, _ in told] == [0, 1, 1, 2] and [k for _, k in told] == [30, 60, 60, 90]
    whole = clustering.dbscan(spark.createDataFrame(rows, SCHEMA), 0.8, 4)
    assert as_rows(incremental.labels(incremental.load(store, "faces", 0.8, 4))) == as_rows(whole)
    assert incremental.load(store, "faces", 0.7, 4).batches == 0
