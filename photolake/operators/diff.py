"""What a rescan of the source folder changes in the photo table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photolake import schema as S
from photolake.functions.text import basename
from photolake.operators.order import ranked


def new_files(files: DataFrame, photos: DataFrame) -> DataFrame:
    """Files (``path, content_hash``) whose path no photo has."""
    return files.join(photos.select("path"), "path", "left_anti")


def surviving(photos: DataFrame, files: DataFrame) -> DataFrame:
    """Photos whose file is still there."""
    return photos.join(files.select("path"), "path", "left_semi")


def missing(photos: DataFrame, files: DataFrame) -> DataFrame:
    """Photos whose file is gone; they stay in the table and are only marked."""
    return photos.join(files.select("path"), "path", "left_anti")


def changed(photos: DataFrame, files: DataFrame) -> DataFrame:
    """``path, new_hash`` of photos whose file has other content; an unreadable file counts as unchanged."""
    now = files.select("path", F.col("content_hash").alias("new_hash")).where("new_hash is not null")
    return photos.select("path", "content_hash").join(now, "path").where(~F.col("content_hash").eqNullSafe(F.col("new_hash"))).select("path", "new_hash")


def as_new_photos(files: DataFrame) -> DataFrame:
    """Photo rows of new files: ungraded, without scores."""
    return files.select("path", basename(F.col("path")).alias("filename"), F.lit(S.UNGRADED).alias("grade"), F.lit(S.UNSET).alias("grade_source"), "content_hash")


def reset_changed(photos: DataFrame, changes: DataFrame) -> DataFrame:
    """Photos with the results of changed files cleared; grades that were set by hand stay.

    The new hash is stored; automatic grade, scores, reason and time of a changed photo go, and its
    faces are to be found again.
    """
    both = photos.join(changes, "path", "left")
    hit = F.col("new_hash").isNotNull()
    auto = hit & (F.col("grade_source") != S.MANUAL)
    out = {"content_hash": F.coalesce("new_hash", "content_hash"), "grade": F.when(auto, F.lit(S.UNGRADED)).otherwise(F.col("grade")), "grade_source": F.when(auto, F.lit(S.UNSET)).otherwise(F.col("grade_source"))}
    for c in ("graded_at", "aesthetic_score", "sharpness_score", "grade_reason"):
        if c in photos.columns:
            out[c] = F.when(~auto, F.col(c))
    if "faces_detected_at" in photos.columns:
        out["faces_detected_at"] = F.when(~hit, F.col("faces_detected_at"))
    return both.withColumns(out).select(*photos.columns)


def drop_changed_faces(faces: DataFrame, changes: DataFrame) -> DataFrame:
    return faces.join(changes.select("path"), "path", "left_anti")


def merged(photos: DataFrame, files: DataFrame) -> DataFrame:
    """The photo table after a rescan: changed photos reset, new ones behind, in one pass over each input."""
    return reset_changed(photos, changed(photos, files)).unionByName(as_new_photos(new_files(files, photos)), allowMissingColumns=True)


def updated(before: DataFrame, now: DataFrame, *compared: str) -> DataFrame:
    """Rows of ``now`` that are new or differ from ``before`` in a compared column."""
    held = before.select("path", F.struct(*compared).alias("_held"))
    return now.join(held, "path", "left").where(~F.col("_held").eqNullSafe(F.struct(*compared))).drop("_held")


def in_order(photos: DataFrame, *by: str) -> DataFrame:
    """``photo_ord``: places by file name, from 0, within ``by`` (a project, say) if given."""
    if not by:
        return ranked(photos, "filename", "path", name="photo_ord")
    window = Window.partitionBy(*by).orderBy("filename", "path")
    return photos.withColumn("photo_ord", (F.row_number().over(window) - 1).cast("long"))
