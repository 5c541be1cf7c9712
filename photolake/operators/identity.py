"""People that last: which of the people known so far each cluster of a new grouping is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photolake.operators.order import ranked
from photolake.storage import discard, materialize


def overlaps(members: DataFrame, grouped: DataFrame, *key: str) -> DataFrame:
    """``person_id, cluster_id, shared, faces``: how many faces (by ``key``) each person has in each cluster, and in all."""
    shared = members.select(*key, "person_id").join(grouped.where("cluster_id is not null").select(*key, "cluster_id"), list(key)).groupBy("person_id", "cluster_id").agg(F.count("*").alias("shared"))
    return shared.join(members.groupBy("person_id").agg(F.count("*").alias("faces")), "person_id")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """The pairs that are taken when the largest ``shared`` comes first and nobody is taken twice.

    Of equal ones the person with fewer ``faces`` comes first, who has the larger part of them there,
    then the smaller ``person_id`` and ``cluster_id``. In each round every pair goes
    that is first both for its person and for its cluster, which is what taking them one by one gives;
    then all others of these two are out. A round is a few shuffles of what is left, and is written down.
    """
    left, taken = materialize(pairs.select("person_id", "cluster_id", "shared", "faces"), "overlaps"), None
    order = (F.col("shared").desc(), "faces", "person_id", "cluster_id")
    while not left.isEmpty():
        first = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1
        both = left.withColumn("p", first("person_id")).withColumn("c", first("cluster_id"))
        now = materialize(both.where("p and c").select(*left.columns), "taken")
        taken = now if taken is None else taken.unionAll(now)
        rest = materialize(left.join(now.select("person_id"), "person_id", "left_anti").join(now.select("cluster_id"), "cluster_id", "left_anti").select(*left.columns), "overlaps")
        discard(left)
        left = rest
    return left if taken is None else taken


def lasting(members: DataFrame, grouped: DataFrame, *key: str) -> DataFrame:
    """``cluster_id, person_id, shared`` of every cluster of a new grouping.

    ``members`` (``key, person_id``) are the faces that people had when last seen, ``grouped`` (``key,
    cluster_id``) is the new grouping. A cluster is the person with whom it shares most faces, one to
    one (:func:`one_to_one`); one that is nobody's gets the next free number, in the order of clusters,
    and a null ``shared``. Nulls among the clusters are no one's faces.
    """
    matched = materialize(one_to_one(overlaps(members, grouped, *key)), "matched")
    clusters = grouped.where("cluster_id is not null").select("cluster_id").distinct()
    top = members.agg(F.max("person_id")).first()[0]
    new = ranked(clusters.join(matched.select("cluster_id"), "cluster_id", "left_anti"), "cluster_id")
    fresh = new.select("cluster_id", (F.col("place") + (0 if top is None else top + 1)).alias("person_id"), F.lit(None).cast("long").alias("shared"))
    return matched.select("cluster_id", F.col("person_id").cast("long").alias("person_id"), "shared").unionAll(fresh)


def remembered(members: DataFrame, grouped: DataFrame, people: DataFrame, *key: str) -> DataFrame:
    """``key, person_id``: the faces of everybody now; who is in no cluster keeps the faces last seen.

    So a person who was taken for another, or whose faces were too few for a while, is known again.
    """
    now = grouped.join(people.select("cluster_id", "person_id"), "cluster_id").select(*key, "person_id")
    return members.select(*key, "person_id").join(now.select("person_id").distinct(), "person_id", "left_anti").select(*key, "person_id").unionAll(now)
