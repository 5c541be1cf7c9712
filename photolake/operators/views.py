"""What a viewer of the collection asks: photos of a person, counts, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photolake import schema as S
from photolake.functions.grading import needs_detection, needs_grading
from photolake.operators.order import ranked
from photolake.operators.people import group_photos, landscape_photos
from photolake.storage import materialize


def of_person(photos: DataFrame, faces: DataFrame, cluster_id: int | None) -> DataFrame:
    """Photos with a face of the cluster; all photos without one, and the virtual groups by their ids."""
    if cluster_id is None:
        return photos
    if cluster_id == S.GROUPS_ID:
        return photos.join(group_photos(faces).select("path"), "path", "left_semi")
    if cluster_id == S.LANDSCAPES_ID:
        return landscape_photos(photos, faces)
    return photos.join(faces.where(F.col("cluster_id") == cluster_id).select("path"), "path", "left_semi")


def by_path(photos: DataFrame, path: str) -> DataFrame:
    """The photo with exactly this path, or no row; the filter reaches the scan."""
    return photos.where(F.col("path") == path).limit(1)


def at_place(photos: DataFrame, place: int, *by: str) -> DataFrame:
    """The photo at ``place``, counted from 0 in the order of file names."""
    if not by:
        return ranked(photos, "filename", "path", name="_place").where(F.col("_place") == place).drop("_place")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("filename", "path"))
    return photos.withColumn("_rank", rank).where(F.col("_rank") == place + 1).drop("_rank")


def moved(place: Column, step: int, count: Column) -> Column:
    """A place moved by ``step``, kept within the list."""
    return F.greatest(F.lit(0), F.least(place + step, count - 1))


def grade_counts(photos: DataFrame) -> DataFrame:
    """One row with the number of photos of each grade; unknown grades count as ungraded."""
    known = {"bad": S.BAD, "ok": S.OK, "good": S.GOOD}
    return photos.agg(*(F.count_if(F.col("grade") == v).alias(k) for k, v in known.items()), F.count_if(~F.coalesce(F.col("grade").isin(*known.values()), F.lit(False))).alias("ungraded"), F.count("*").alias("total"))


def with_face_counts(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """Photos with ``n_faces``, by which a viewer sees that faces were found."""
    counts = faces.groupBy("path").agg(F.count("*").alias("n_faces"))
    return photos.join(counts, "path", "left").withColumn("n_faces", F.coalesce("n_faces", F.lit(0)))


def progress(photos: DataFrame) -> DataFrame:
    """How many photos wait for each stage, and the stage that runs."""
    counted = photos.agg(F.count_if(needs_grading(F.col("graded_at"), F.col("grade_source"))).alias("to_grade"), F.count_if(needs_detection(F.col("faces_detected_at"))).alias("to_detect"), F.count("*").alias("total"))
    return counted.withColumn("stage", F.when(F.col("to_grade") > 0, F.lit("grading")).when(F.col("to_detect") > 0, F.lit("faces")).otherwise(F.lit("complete")))


def navigation(photos: DataFrame, *by: str) -> DataFrame:
    """Each photo's place from 1, the number of photos, and its neighbours, without a wrap at the ends.

    Within ``by`` (a project, say) these are windows; over a whole table, joins of places with the next.
    """
    if by:
        order, every = Window.partitionBy(*by).orderBy("filename", "path"), Window.partitionBy(*by)
        place = F.row_number().over(order)
        return photos.select(*by, "path", place.cast("long").alias("place"), F.count("*").over(every).alias("of"), F.coalesce(F.lag("path").over(order), F.col("path")).alias("previous"), F.coalesce(F.lead("path").over(order), F.col("path")).alias("next"))
    placed = materialize(ranked(photos.select("path", "filename"), "filename", "path").select("path", F.col("place") + 1), "places").toDF("path", "place")
    before = placed.select((F.col("place") + 1).alias("place"), F.col("path").alias("before"))
    after = placed.select((F.col("place") - 1).alias("place"), F.col("path").alias("after"))
    both = placed.join(before, "place", "left").join(after, "place", "left")
    return both.select("path", "place", F.lit(placed.count()).cast("long").alias("of"), F.coalesce("before", "path").alias("previous"), F.coalesce("after", "path").alias("next"))


def changed_values(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Rows whose value differs from the one before of the same key; a key's first is no change."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))
