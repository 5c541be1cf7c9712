"""Plans of what is copied where, and what is thrown away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photolake import schema as S
from photolake.functions.grading import exported
from photolake.functions.text import destination


def flat_plan(photos: DataFrame, which: str, folder: str) -> DataFrame:
    """``path, dest`` of the photos that pass the grade filter."""
    return photos.where(exported(F.col("grade"), which)).select("path", destination(folder, F.col("filename")).alias("dest"))


def first_faces(faces: DataFrame) -> DataFrame:
    """Each photo's first face, the most confident one that was kept."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy("face_ord"))
    return faces.withColumn("place", rank).where("place = 1").select("path", "cluster_id")


def plan_by_person(photos: DataFrame, faces: DataFrame, people: DataFrame, which: str, folder: str, everyone: bool = False) -> DataFrame:
    """``path, dest`` with a folder for the person of each photo's first face, or one for each person in it.

    Photos without faces, or whose face belongs to nobody, go to ``Ungrouped``.
    """
    of = faces.where("cluster_id is not null").select("path", "cluster_id").distinct() if everyone else first_faces(faces)
    labelled = of.join(people.select("cluster_id", "label"), "cluster_id", "left").select("path", "label")
    chosen = photos.where(exported(F.col("grade"), which)).join(labelled, "path", "left")
    return chosen.select("path", destination(folder, F.col("filename"), F.coalesce("label", F.lit("Ungrouped"))).alias("dest"))


def trash_plan(photos: DataFrame) -> DataFrame:
    """Photos graded bad, which are moved after the copies are made."""
    return photos.where(F.col("grade") == S.BAD).select("path", F.concat(F.regexp_extract("path", "^(.*/)[^/]*$", 1), F.lit("_trash/"), F.col("filename")).alias("dest"))


def export_counts(photos: DataFrame) -> DataFrame:
    """How many photos each grade filter passes, and how many are bad."""
    return photos.agg(*(F.count_if(exported(F.col("grade"), w)).alias(n) for n, w in (("n_all", "All"), ("n_ok_and_good", "OkAndGood"), ("n_good", "GoodOnly"))), F.count_if(F.col("grade") == S.BAD).alias("n_trash"))
