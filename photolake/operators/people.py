"""People and the two virtual groups, made from clustered faces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake import schema as S


def people(faces: DataFrame) -> DataFrame:
    """One row for each cluster: label, most confident face, number of photos.

    The label tells the cluster's number, from 1, so it stays while the number does.
    The first of equally confident faces, by photo and place, stands for the cluster. A cluster
    without a face of confidence over 0 has no representative and a box of zeros.
    """
    sure = F.col("confidence") > 0
    place = F.struct(F.col("confidence"), -F.col("photo_ord"), -F.col("face_ord"))
    shown = F.struct("path", "x1", "y1", "x2", "y2")
    grouped = faces.where("cluster_id is not null").groupBy("cluster_id").agg(F.countDistinct("path").alias("photo_count"), F.max_by(F.when(sure, shown), F.when(sure, place)).alias("best"))
    zero = lambda c: F.coalesce(F.col(f"best.{c}"), F.lit(0.0)).alias(c)
    return grouped.select("cluster_id", F.concat(F.lit("Person "), (F.col("cluster_id") + 1).cast("string")).alias("label"), F.coalesce("best.path", F.lit("")).alias("representative"), zero("x1"), zero("y1"), zero("x2"), zero("y2"), "photo_count")


def group_photos(faces: DataFrame) -> DataFrame:
    """Photos with faces of more than one person."""
    return faces.groupBy("path").agg(F.countDistinct("cluster_id").alias("people")).where("people > 1")


def landscape_photos(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """Photos that were searched for faces and have none."""
    return photos.where("faces_detected_at is not null").join(faces.select("path"), "path", "left_anti")


def _virtual(found: DataFrame, cluster_id: int, label: str) -> DataFrame:
    zeros = [F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")]
    counted = found.agg(F.count("*").alias("photo_count"), F.min("path").alias("representative")).where("photo_count > 0")
    return counted.select(F.lit(cluster_id).cast("long").alias("cluster_id"), F.lit(label).alias("label"), "representative", *zeros, "photo_count")


def summary(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """People by number, then Groups, then Landscapes, each of the two if it has photos."""
    rows = people(faces).withColumn("kind", F.lit(0))
    rows = rows.unionByName(_virtual(group_photos(faces), S.GROUPS_ID, "Groups").withColumn("kind", F.lit(1)))
    return rows.unionByName(_virtual(landscape_photos(photos, faces), S.LANDSCAPES_ID, "Landscapes").withColumn("kind", F.lit(2)))
