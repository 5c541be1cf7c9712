"""Queries over detected boxes: decoding, gates, overlap, suppression, and landmark alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions import geometry
from photolake.operators import detection
from photolake.plans import fixtures as X
from photolake.plans.catalog import query
from photolake.plans.views import iou, over

SIDES = ("x1", "y1", "x2", "y2")


@query(over("select vec_id, confidence from faces where confidence >= 0.5", "faces"))
def conf_gate(spark, sf_dir: str) -> DataFrame:
    return detection.confident(X.faces(spark, sf_dir), 0.5).select("vec_id", "confidence")


@query(over("select vec_id from faces where least(x2 - x1, y2 - y1) >= 80", "faces"))
def size_gate(spark, sf_dir: str) -> DataFrame:
    return detection.large_enough(X.faces(spark, sf_dir), 80.0).select("vec_id")


@query(over("select vec_id, greatest(0.0, least(x1, 180.0)) as x1, greatest(0.0, least(y1, 120.0)) as y1, greatest(0.0, least(x2, 180.0)) as x2, greatest(0.0, least(y2, 120.0)) as y2 from faces", "faces"))
def clip_boxes(spark, sf_dir: str) -> DataFrame:
    return detection.clipped(X.faces(spark, sf_dir), F.lit(180.0), F.lit(120.0)).select("vec_id", *SIDES)


@query(over(f"select a.photo_ord, a.face_ord as a, b.face_ord as b, round({iou('a', 'b')}, 6) as iou from gated a join gated b on a.photo_ord = b.photo_ord and a.face_ord < b.face_ord where {iou('a', 'b')} > 0.4", "gated"))
def iou_pairs(spark, sf_dir: str) -> DataFrame:
    """Pairs of a photo's boxes that overlap too much."""
    return detection.overlaps(X.gated(spark, sf_dir), "photo_ord", 0.4).select("photo_ord", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("iou", 6).alias("iou"))


@query(over("select photo_ord, vec_id, confidence, x1, y1, x2, y2 from unsuppressed", "unsuppressed"))
def nms(spark, sf_dir: str) -> DataFrame:
    return detection.suppressed(X.gated(spark, sf_dir), "photo_ord", 0.4, "vec_id").select("photo_ord", "vec_id", "confidence", *SIDES)


@query(over("select photo_ord, vec_id, rank from capped", "capped"))
def face_cap(spark, sf_dir: str) -> DataFrame:
    """The most confident faces of each photo, at most ten."""
    found = detection.capped(detection.suppressed(X.gated(spark, sf_dir), "photo_ord", 0.4, "vec_id"), "photo_ord", 10)
    return found.select("photo_ord", "vec_id", F.col("rank").cast("long").alias("rank"))


#: Detector outputs made from the vectors: stride, flat anchor index, score and four distances.
RAW_SQL = """raw as (select vec_id, case vec_id % 3 when 0 then 8 when 1 then 16 else 32 end::bigint as stride, (vec_id * 13) % 800 as "index", embedding[1]::double * 8 as score,
    abs(embedding[2]::double) * 4 as d_left, abs(embedding[3]::double) * 4 as d_top, abs(embedding[4]::double) * 4 as d_right, abs(embedding[5]::double) * 4 as d_bottom,
    800 + vec_id % 1000 as width, 600 + vec_id % 700 as height from embeddings),
    boxed as (select *, least(640.0::double / width, 640.0::double / height) as scale from raw),
    padded as (select *, floor((640 - floor(width * scale)) / 2) as pad_x, floor((640 - floor(height * scale)) / 2) as pad_y, floor("index" / 2) as cell, floor(640 / stride) as cells from boxed),
    placed as (select *, (cell % cells + 0.5) * stride as cx, (floor(cell / cells) + 0.5) * stride as cy from padded)"""


def _raw(spark, sf_dir: str) -> DataFrame:
    i, e = F.col("vec_id"), F.col("embedding")
    at = lambda k: F.abs(F.get(e, F.lit(k)).cast("double")) * 4
    raw = X.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.element_at(F.array(F.lit(8), F.lit(16), F.lit(32)), (i % 3 + 1).cast("int")).cast("long").alias("stride"), (i * 13 % 800).alias("index"),
        (F.get(e, F.lit(0)).cast("double") * 8).alias("score"), at(1).alias("d_left"), at(2).alias("d_top"), at(3).alias("d_right"), at(4).alias("d_bottom"), (i % 1000 + 800).alias("width"), (i % 700 + 600).alias("height"),
    )
    return raw.withColumns(geometry.letterbox(F.col("width"), F.col("height"), 640))


@query(f"with {RAW_SQL} select vec_id, round(scale, 6) as scale, floor(width * scale)::bigint as new_width, floor(height * scale)::bigint as new_height, pad_x::bigint as pad_x, pad_y::bigint as pad_y from placed")
def letterbox(spark, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("vec_id", F.round("scale", 6).alias("scale"), *(F.col(c).cast("long").alias(c) for c in ("new_width", "new_height", "pad_x", "pad_y")))


@query(
    f"""with {RAW_SQL} select vec_id, round(1 / (1 + exp(-score)), 6) as confidence, round((cx - d_left * stride - pad_x) / scale, 6) as x1, round((cy - d_top * stride - pad_y) / scale, 6) as y1,
    round((cx + d_right * stride - pad_x) / scale, 6) as x2, round((cy + d_bottom * stride - pad_y) / scale, 6) as y2 from placed"""
)
def decode_boxes(spark, sf_dir: str) -> DataFrame:
    """Boxes in image pixels from anchors, distances and the letterbox."""
    found = detection.decoded(_raw(spark, sf_dir), 640)
    return found.select("vec_id", *(F.round(c, 6).alias(c) for c in ("confidence", *SIDES)))


#: Five landmarks made from the first ten components, moved onto the next ten.
POINTS_SQL = """pts as (select vec_id, k, embedding[2 * k + 1]::double * 100 + k * 7 as x, embedding[2 * k + 2]::double * 100 + k * k * 3 as y,
    embedding[2 * k + 11]::double * 50 + k * 5 as u, embedding[2 * k + 12]::double * 50 + k * 2 as v from embeddings, range(0, 5) ks(k)),
    sums as (select vec_id, 5 as n, sum(x) as sx, sum(y) as sy, sum(u) as su, sum(v) as sv, sum(x * u) as sxu, sum(y * v) as syv, sum(x * v) as sxv, sum(y * u) as syu, sum(x * x + y * y) as sq from pts group by vec_id),
    solved as (select *, (sxu + syv - (sx * su + sy * sv) / n) / nullif(sq - (sx * sx + sy * sy) / n, 0) as a, (sxv - syu - (sx * sv - sy * su) / n) / nullif(sq - (sx * sx + sy * sy) / n, 0) as b from sums),
    moved as (select *, (su - a * sx + b * sy) / n as tx, (sv - b * sx - a * sy) / n as ty from solved)"""


def _aligned(spark, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    at = lambda i: F.get(e, i).cast("double")
    point = lambda k: F.struct((at(2 * k) * 100 + k * 7).alias("x"), (at(2 * k + 1) * 100 + k * k * 3).alias("y"), (at(2 * k + 10) * 50 + k * 5).alias("u"), (at(2 * k + 11) * 50 + k * 2).alias("v"))
    p = X.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(4)), point).alias("pairs"))
    return detection.aligned(p, "pairs")


@query(f"with {POINTS_SQL} select vec_id, round(a, 6) as a, round(b, 6) as b, round(tx, 4) as tx, round(ty, 4) as ty from moved")
def similarity_transform(spark, sf_dir: str) -> DataFrame:
    """Turn, scale and shift that bring landmarks closest to their template."""
    return _aligned(spark, sf_dir).select("vec_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("tx", 4).alias("tx"), F.round("ty", 4).alias("ty"))


@query(f"with {POINTS_SQL} select vec_id, round(a / (a * a + b * b), 4) as ia, round(-b / (a * a + b * b), 4) as ib from moved where a * a + b * b > 0.01")
def inverse_transform(spark, sf_dir: str) -> DataFrame:
    found = _aligned(spark, sf_dir).where("a * a + b * b > 0.01")
    inverse = geometry.inverse_similarity(*(F.col(c) for c in ("a", "b", "tx", "ty")))
    return found.select("vec_id", F.round(inverse["ia"], 4).alias("ia"), F.round(inverse["ib"], 4).alias("ib"))


@query(over("select vec_id from faces where 40 + vec_id % 60 between x1 and x2 and 30 + vec_id % 90 between y1 and y2", "faces"))
def landmark_gate(spark, sf_dir: str) -> DataFrame:
    """Faces whose eyes and nose lie in the box."""
    point = F.struct((F.col("vec_id") % 60 + 40).cast("double").alias("x"), (F.col("vec_id") % 90 + 30).cast("double").alias("y"))
    return detection.landmarks_inside(X.faces(spark, sf_dir).withColumn("keypoints", F.array(point, point, point)), "keypoints").select("vec_id")
