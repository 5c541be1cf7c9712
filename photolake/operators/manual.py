"""Grades set by hand, kept beside the automatic ones so that no run overwrites them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake import schema as S


def with_manual_grades(photos: DataFrame, manual: DataFrame) -> DataFrame:
    """Photos with the grades of ``manual`` (``path, manual_grade``); time and reason stay as they are."""
    both = photos.join(manual, "path", "left")
    set_ = F.col("manual_grade").isNotNull()
    return both.withColumns({"grade": F.coalesce("manual_grade", "grade"), "grade_source": F.when(set_, F.lit(S.MANUAL)).otherwise(F.col("grade_source"))}).select(*photos.columns)


def latest_edits(edits: DataFrame) -> DataFrame:
    """The last edit of each path from ``path, grade, version``."""
    return edits.groupBy("path").agg(F.max_by("grade", "version").alias("manual_grade"))


def renamed_clusters(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """Clusters with labels of ``cluster_id, new_label`` where there is one."""
    return clusters.join(names, "cluster_id", "left").withColumn("label", F.coalesce("new_label", "label")).drop("new_label")
