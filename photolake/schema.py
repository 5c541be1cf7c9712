"""Tables of a photo collection."""

from __future__ import annotations

from pyspark.sql import types as T

UNGRADED, BAD, OK, GOOD = "Ungraded", "Bad", "Ok", "Good"
UNSET, MANUAL, AUTO = "Unset", "Manual", "Auto"
GROUPS_ID, LANDSCAPES_ID = -1, -2

BBOX = T.StructType([T.StructField(c, T.FloatType()) for c in ("x1", "y1", "x2", "y2")])

PHOTOS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("project_id", "path", "filename")]
    + [T.StructField("photo_ord", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("grade", "grade_source")]
    + [T.StructField(c, T.FloatType()) for c in ("aesthetic_score", "sharpness_score")]
    + [T.StructField(c, T.StringType()) for c in ("grade_reason", "content_hash")]
    + [T.StructField(c, T.LongType()) for c in ("graded_at", "faces_detected_at")]
)

FACES = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("photo_ord", T.LongType()),
        T.StructField("face_ord", T.IntegerType()),
        T.StructField("bbox", BBOX),
        T.StructField("confidence", T.FloatType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("cluster_id", T.LongType()),
    ]
)
