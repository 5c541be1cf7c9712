"""Grading of photos from the measures of their pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.config import Config
from photolake.functions import grading, raster
from photolake.schema import AUTO, BAD


def graded(measures: DataFrame, now: int, config: Config = Config()) -> DataFrame:
    """``path, new_grade, new_score, new_sharpness, new_reason, now, error`` from measures.

    Bad photos bear no aesthetic score. A photo without measures keeps its grade and is marked as
    seen at ``now``, seconds since 1970 and the same for a whole run.
    """
    over, under = F.col("bright") > config.exposure_clip_threshold, F.col("dark") > config.exposure_clip_threshold
    score = raster.aesthetic(F.col("contrast"), F.col("saturation"))
    grade = grading.grade(F.col("sharpness"), over, under, score, config.sharpness_threshold, config.aesthetic_good_threshold)
    reason = grading.reason(F.col("sharpness"), over, under, score, config.sharpness_threshold)
    seen = F.col("sharpness").isNotNull()
    found = measures.select("path", F.when(seen, grade).alias("new_grade"), F.when(seen, score).alias("score"), F.col("sharpness").cast("float").alias("new_sharpness"), F.when(seen, reason).alias("new_reason"), F.lit(now).cast("long").alias("now"), "error")
    return found.withColumn("new_score", F.when(F.col("new_grade") != BAD, F.col("score")).cast("float")).drop("score")


def with_grades(photos: DataFrame, grades: DataFrame) -> DataFrame:
    """Photos with new automatic grades; a grade set by hand stays as it is."""
    both = photos.join(grades.drop("error"), "path", "left")
    hit = F.col("now").isNotNull() & grading.needs_grading(F.col("graded_at"), F.col("grade_source"))
    scored = hit & F.col("new_grade").isNotNull()
    return both.withColumns(
        {
            "grade": F.when(scored, F.col("new_grade")).otherwise(F.col("grade")),
            "grade_source": F.when(scored, F.lit(AUTO)).otherwise(F.col("grade_source")),
            "aesthetic_score": F.when(scored, F.col("new_score")).otherwise(F.col("aesthetic_score")),
            "sharpness_score": F.when(scored, F.col("new_sharpness")).otherwise(F.col("sharpness_score")),
            "grade_reason": F.when(scored, F.col("new_reason")).otherwise(F.col("grade_reason")),
            "graded_at": F.when(hit, F.col("now")).otherwise(F.col("graded_at")),
        }
    ).select(*photos.columns)
