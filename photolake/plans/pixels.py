"""Queries over small rasters: sharpness, exposure, contrast, saturation, grades and their reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions import grading, raster
from photolake.plans import fixtures as X
from photolake.plans.catalog import query
from photolake.plans.views import over

#: Thresholds that tell the small rasters apart.
SHARP_AT, CLIP, GOOD_AT = 55_000.0, 0.06, 5.5


def _measures(spark, sf_dir: str) -> DataFrame:
    over_, under = raster.exposure(F.col("gray"), CLIP)
    side = F.lit(8)
    return X.rasters(spark, sf_dir).select("vec_id", raster.laplacian_variance(F.col("gray"), side, side).alias("sharpness"), over_.alias("over_"), under.alias("under_"), raster.contrast(F.col("gray")).alias("contrast"), raster.saturation(F.col("rgb")).alias("saturation"))


def _scored(spark, sf_dir: str) -> DataFrame:
    s = _measures(spark, sf_dir).withColumn("score", raster.aesthetic(F.col("contrast"), F.col("saturation")))
    grade = grading.grade(F.col("sharpness"), F.col("over_"), F.col("under_"), F.col("score"), SHARP_AT, GOOD_AT)
    return s.withColumn("grade", grade)


@query(over("select vec_id, round(sharpness, 4) as sharpness from sharpness", "sharpness"))
def image_sharpness(spark, sf_dir: str) -> DataFrame:
    return _measures(spark, sf_dir).select("vec_id", F.round("sharpness", 4).alias("sharpness"))


@query(over("select vec_id, over_ as overexposed, under_ as underexposed from measures", "measures"))
def image_exposure(spark, sf_dir: str) -> DataFrame:
    return _measures(spark, sf_dir).select("vec_id", F.col("over_").alias("overexposed"), F.col("under_").alias("underexposed"))


@query(over("select vec_id, round(contrast, 6) as contrast from measures", "measures"))
def image_contrast(spark, sf_dir: str) -> DataFrame:
    return _measures(spark, sf_dir).select("vec_id", F.round("contrast", 6).alias("contrast"))


@query(over("select vec_id, round(saturation, 6) as saturation from measures", "measures"))
def image_saturation(spark, sf_dir: str) -> DataFrame:
    return _measures(spark, sf_dir).select("vec_id", F.round("saturation", 6).alias("saturation"))


@query(over("select vec_id, round(score, 6) as score from scored", "scored"))
def aesthetic_score(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("vec_id", F.round("score", 6).alias("score"))


@query(over("select vec_id, grade, case when grade <> 'Bad' then round(score, 6) end as aesthetic_score from graded", "graded"))
def auto_grade(spark, sf_dir: str) -> DataFrame:
    """Grades; bad photos bear no aesthetic score."""
    return _scored(spark, sf_dir).select("vec_id", "grade", F.when(F.col("grade") != "Bad", F.round("score", 6)).alias("aesthetic_score"))


REASON = """case when sharpness < 55000 or over_ or under_ then concat_ws(', ', case when sharpness < 55000 then 'Blurry (sharpness: ' || printf('%.0f', sharpness) || ')' end,
    case when over_ then 'Overexposed' end, case when under_ then 'Underexposed' end) else 'Aesthetic score: ' || printf('%.1f', score) || '/10' end"""


@query(over(f"select vec_id, {REASON} as reason from scored", "scored"))
def grade_reason(spark, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select("vec_id", grading.reason(F.col("sharpness"), F.col("over_"), F.col("under_"), F.col("score"), SHARP_AT).alias("reason"))


@query(
    over(
        """select vec_id, case when vec_id % 3 = 0 then 'kept' when vec_id % 3 = 1 then
          case when grade = 'Bad' and sharpness < 55000 then 'Blurry (sharpness: ' || printf('%.0f', sharpness) || ')' when grade = 'Bad' then 'Exposure issue (over/underexposed)' else 'Aesthetic: ' || printf('%.1f', score) end end as shown,
          case when grade = 'Ok' then 'OK' else grade end as grade_label, case when vec_id % 3 = 1 then 'auto' else 'manual' end as source_label from graded""",
        "graded",
    )
)
def display_reason(spark, sf_dir: str) -> DataFrame:
    """What is shown: a stored reason, one made from the scores of automatic grades, or nothing."""
    kind = F.col("vec_id") % 3
    stored = F.when(kind == 0, F.lit("kept"))
    source = F.when(kind == 1, F.lit("Auto")).when(kind == 2, F.lit("Manual")).otherwise(F.lit("Unset"))
    shown = grading.shown_reason(stored, source, F.col("grade"), F.col("sharpness"), F.col("score"), SHARP_AT)
    return _scored(spark, sf_dir).select("vec_id", shown.alias("shown"), grading.grade_label(F.col("grade")).alias("grade_label"), grading.source_label(source).alias("source_label"))


@query("select p_partkey, greatest(round((p_size * 37 + 9) * 500.0 / greatest(p_size * 37 + 9, p_partkey % 900 + 1))::bigint, 3) as width, greatest(round((p_partkey % 900 + 1) * 500.0 / greatest(p_size * 37 + 9, p_partkey % 900 + 1))::bigint, 3) as height from part")
def resized_sides(spark, sf_dir: str) -> DataFrame:
    """Sizes that images are brought to before their sharpness is measured."""
    width, height = F.col("p_size") * 37 + 9, F.col("p_partkey") % 900 + 1
    w, h = raster.resized(width, height, 500)
    return X.table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"))


@query("select p_partkey, floor((2126 * (p_partkey % 256) + 7152 * (p_size % 256) + 722 * (p_partkey * 7 % 256)) / 10000)::bigint as luma from part")
def luminance(spark, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return X.table(spark, sf_dir, "part").select("p_partkey", raster.luma(key % 256, size % 256, key * 7 % 256).cast("long").alias("luma"))
