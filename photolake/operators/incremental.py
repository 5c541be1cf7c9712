"""DBSCAN that grows: new vectors are compared with their surroundings alone, and what was found stays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photolake.operators import clustering as C
from photolake.operators.components import connected_components
from photolake.operators.order import ranked
from photolake.sources.projects import Store
from photolake.storage import materialize

VECTORS = "cid long, n long, size int, vec binary, group long"
SPANS = "group long, size int, low array<double>, high array<double>"
POINTS = "cid long, degree long, root long"
BESIDE = "cid long, root long"
ABOUT = "eps double, least int, batches int, pivots array<array<double>>"


class Grouping(NamedTuple):
    """What is known of all vectors so far.

    ``vectors`` and ``spans`` only grow; ``points`` has each vector's ``degree`` (itself included) and the
    smallest core vector of its component, null unless it is core; ``beside`` the components next to
    vectors that are not core.
    """

    eps: float
    least: int
    batches: int
    pivots: np.ndarray
    vectors: DataFrame
    spans: DataFrame
    points: DataFrame
    beside: DataFrame


def empty(spark: SparkSession, eps: float, least: int) -> Grouping:
    frames = [spark.createDataFrame([], x) for x in (VECTORS, SPANS, POINTS, BESIDE)]
    return Grouping(eps, least, 0, np.empty((0, 0)), *frames)


def added(g: Grouping, vectors: DataFrame) -> Grouping:
    """The grouping with more vectors (``ord`` long, ``embedding``), the same as if all had come at once.

    Vectors that are known by their ``ord`` are left out, so a batch may be run again; of rows that
    share an ``ord`` in a batch one stays, and null and empty vectors are near nothing. The first batch
    chooses the pivots, which tell for every later one what lies too far off.

    The new vectors' groups are compared with the groups that they may meet, and each near pair counts
    for both. Vectors that have become core are compared once more, to find what they join; components
    known before take part as one node each. Nothing is compared that has no new vector and no vector
    that has become core in either group.
    """
    spark = vectors.sparkSession
    fresh = vectors.select("ord", "embedding").dropDuplicates(["ord"]).join(g.points.select(F.col("cid").alias("ord")), "ord", "left_anti")
    rows = materialize(fresh, "batch")
    packed = C._packed(C._doubles(rows).select(F.col("ord").alias("cid"), F.lit(1).cast("long").alias("n"), "embedding"))
    count = packed.count()
    pivots = g.pivots if len(g.pivots) else C.pivots_of(packed, count)
    each = C.group_rows(count + g.points.count(), pivots)
    placed = materialize(C.in_cells(packed, pivots), "placed")
    cells = C.spans_of(placed.withColumn("group", F.col("cell")), pivots).join(placed.groupBy(F.col("cell").alias("group")).agg(F.count("*").alias("k")), "group").where("group >= 0").orderBy("group").collect() if len(pivots) else []
    of = [np.array([r[c] for r in cells]) for c in ("group", "k", "low", "high")]
    groups, _ = C.wide_enough(*of, pivots, g.eps, int(spark.conf.get("spark.sql.shuffle.partitions")), each)
    mine = C.in_groups(placed, groups, each).withColumn("group", F.col("group") + (g.batches << 16))
    mine = materialize(mine.select(*(c.split()[0] for c in VECTORS.split(", "))), "grouped")
    spans = materialize(C.spans_of(mine, pivots), "spans")
    every, all_spans = g.vectors.unionByName(mine), g.spans.unionByName(spans)

    pairs = materialize(C.meeting(g.spans.withColumn("fresh", F.lit(False)).unionByName(spans.withColumn("fresh", F.lit(True))), g.eps), "meeting")
    counts = C._tiles(every, pairs).mapInArrow(C._counted(g.eps), "cid long, k long").groupBy("cid").agg(F.sum("k").alias("k"))
    known = g.points.withColumn("new", F.lit(False)).unionByName(rows.select(F.col("ord").alias("cid"), F.lit(1).cast("long").alias("degree"), F.lit(None).cast("long").alias("root"), F.lit(True).alias("new")))
    degree = F.col("degree") + F.coalesce("k", F.lit(0))
    points = known.join(counts, "cid", "left").select("cid", degree.alias("degree"), "root", "new", (degree >= g.least).alias("core"))
    points = materialize(points.withColumn("asks", F.col("new") | (F.col("core") & F.col("root").isNull())), "points")

    # groups with a new vector or one that has become core
    marked = every.join(points.drop("degree"), "cid")
    asking = marked.where("asks").select("group").distinct().withColumn("fresh", F.lit(True))
    pairs = materialize(C.meeting(all_spans.join(asking, "group", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))), g.eps), "meeting")
    links = materialize(C._tiles(marked, pairs, "core", "asks").mapInArrow(C._linked(g.eps, "asks"), "a long, b long, inner boolean"), "links")

    # a component that was known is the node of its root, a new core vector its own
    node = materialize(points.where("core").select("cid", F.coalesce("root", "cid").alias("node")), "nodes")
    ends = links.join(node.select(F.col("cid").alias("a"), F.col("node").alias("x")), "a")
    inner = ends.where("inner and a <> b").join(node.select(F.col("cid").alias("b"), F.col("node").alias("y")), "b").where("x <> y")
    joined = materialize(connected_components(inner, "x", "y"), "joined")
    roots = materialize(node.join(joined, "node", "left").select("cid", F.coalesce("component", "node").alias("root")), "roots")
    after = materialize(points.select("cid", "degree").join(roots, "cid", "left"), "points")
    moved = joined.select(F.col("node").alias("root"), "component")
    before = g.beside.join(moved, "root", "left").select("cid", F.coalesce("component", "root").alias("root"))
    beside = before.unionByName(links.where("not inner").join(roots.withColumnRenamed("cid", "a"), "a").select(F.col("b").alias("cid"), "root"))
    beside = materialize(beside.distinct().join(after.where("root is null").select("cid"), "cid", "left_semi"), "beside")
    return Grouping(g.eps, g.least, g.batches + 1, pivots, every, all_spans, after, beside)


def labels(g: Grouping) -> DataFrame:
    """``ord, degree, cluster_id`` of every vector, as :func:`photolake.operators.clustering.dbscan` gives them for all."""
    numbers = materialize(ranked(g.points.where("root is not null").select("root").distinct(), "root", name="cluster_id").select("root", "cluster_id"), "numbers")
    border = g.beside.join(numbers, "root").groupBy("cid").agg(F.min("cluster_id").alias("near"))
    found = g.points.join(numbers, "root", "left").join(border, "cid", "left")
    return found.select(F.col("cid").alias("ord"), "degree", F.coalesce("cluster_id", "near").alias("cluster_id"))


def save(g: Grouping, store: Store, name: str) -> None:
    """Write a grouping as a new version of its tables; it counts once the last of them is there."""
    for table in ("vectors", "spans", "points", "beside"):
        store.write(getattr(g, table), f"grouping_{table}", f"{name}_{g.batches}")
    about = [(g.eps, g.least, g.batches, g.pivots.tolist())]
    store.write(store.spark.createDataFrame(about, ABOUT).coalesce(1), "grouping", name)
    if g.batches > 1:
        for table in ("vectors", "spans", "points", "beside"):
            store.drop(f"grouping_{table}", f"{name}_{g.batches - 2}")


def load(store: Store, name: str, eps: float, least: int) -> Grouping:
    """The grouping that was saved last; an empty one where there is none, or one of another radius or number."""
    about = store.read("grouping", name, T._parse_datatype_string(ABOUT)).collect()
    if not about or (about[0]["eps"], about[0]["least"]) != (eps, least):
        return empty(store.spark, eps, least)
    n = about[0]["batches"]
    kinds = zip(("vectors", "spans", "points", "beside"), (VECTORS, SPANS, POINTS, BESIDE))
    frames = [store.read(f"grouping_{table}", f"{name}_{n}", T._parse_datatype_string(kind)) for table, kind in kinds]
    return Grouping(eps, least, n, np.array(about[0]["pivots"], float), *frames)
