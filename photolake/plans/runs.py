"""Queries over what runs take in and leave behind: grades, faces, documents, copies, places."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.config import Config
from photolake.functions import raster
from photolake.operators import diff, enrichment, export, models, views
from photolake.plans import fixtures as X
from photolake.plans.catalog import query
from photolake.plans.detections import RAW_SQL, SIDES, _raw
from photolake.plans.pixels import CLIP, GOOD_AT, REASON, SHARP_AT
from photolake.plans.views import iou, over
from photolake.sources import projects, sinks

#: The second at which the run of these queries takes place.
NOW = 7000


@query(
    over(
        f""", run as (select '/p/IMG_' || vec_id || '.jpg' as path, vec_id % 11 = 0 as lost, grade as new_grade, score, sharpness, {REASON} as reason from graded),
        laid as (select p.*, r.lost, r.new_grade, r.score, r.sharpness, r.reason, r.path is not null and p.graded_at is null and p.grade_source <> 'Manual' as hit, not coalesce(r.lost, true) as seen from photos p left join run r on r.path = p.path)
        select path, case when hit and seen then new_grade else grade end as grade, case when hit and seen then 'Auto' else grade_source end as grade_source,
          case when hit and seen and new_grade <> 'Bad' then round(score::float::double, 4) end as aesthetic_score, case when hit and seen then round(sharpness::float::double, 1) end as sharpness_score,
          case when hit and seen then reason end as grade_reason, case when hit then {NOW} else graded_at end as graded_at
        from laid""",
        "graded",
        "photos",
    )
)
def grade_run(spark, sf_dir: str) -> DataFrame:
    """The photo table after a run of grading: pictures that do not open are only marked, grades set by hand stay."""
    share = lambda test: F.size(F.filter("gray", test)) / 64
    side, opens = F.lit(8), F.col("vec_id") % 11 != 0
    measures = X.rasters(spark, sf_dir).select(
        F.concat(F.lit("/p/IMG_"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("path"), F.when(opens, raster.laplacian_variance(F.col("gray"), side, side)).alias("sharpness"),
        share(lambda v: v >= 246).alias("bright"), share(lambda v: v < 10).alias("dark"), raster.contrast(F.col("gray")).alias("contrast"), raster.saturation(F.col("rgb")).alias("saturation"), F.when(~opens, F.lit("does not open")).alias("error"),
    )
    settings = replace(Config(), sharpness_threshold=SHARP_AT, exposure_clip_threshold=CLIP, aesthetic_good_threshold=GOOD_AT)
    photos = X.photos(spark, sf_dir).withColumns({c: F.lit(None).cast(t) for c, t in (("aesthetic_score", "float"), ("sharpness_score", "float"), ("grade_reason", "string"))})
    after = enrichment.with_grades(photos, enrichment.graded(measures, NOW, settings))
    return after.select("path", "grade", "grade_source", F.round(F.col("aesthetic_score").cast("double"), 4).alias("aesthetic_score"), F.round(F.col("sharpness_score").cast("double"), 1).alias("sharpness_score"), "grade_reason", "graded_at")


@query(
    f"""with {RAW_SQL},
    found as (select vec_id // 2 as photo, stride, "index", 1 / (1 + exp(-score)) as confidence, width, height,
      (cx - d_left * stride - pad_x) / scale as x1, (cy - d_top * stride - pad_y) / scale as y1, (cx + d_right * stride - pad_x) / scale as x2, (cy + d_bottom * stride - pad_y) / scale as y2,
      (cx + embedding[6]::double * stride - pad_x) / scale as eye_x, (cy + embedding[7]::double * stride - pad_y) / scale as eye_y, (cx + embedding[14]::double * stride - pad_x) / scale as mouth_x, (cy + embedding[15]::double * stride - pad_y) / scale as mouth_y
      from placed join embeddings using (vec_id)),
    passed as (select * replace (greatest(0.0, least(x1, width)) as x1, greatest(0.0, least(y1, height)) as y1, greatest(0.0, least(x2, width)) as x2, greatest(0.0, least(y2, height)) as y2),
      row_number() over (partition by photo order by confidence desc, stride, "index") as turn from found where confidence >= 0.5 and least(x2 - x1, y2 - y1) >= 20),
    stays as (select * from passed b where turn = 1 or not exists (select 1 from passed a where a.photo = b.photo and a.turn = 1 and {iou('a', 'b')} > 0.4))
    select photo::varchar as path, row_number() over (partition by photo order by turn) - 1 as face_ord, round(confidence, 6) as confidence, round(x1, 4) as x1, round(y1, 4) as y1, round(x2, 4) as x2, round(y2, 4) as y2,
      round(eye_x, 4) as eye_x, round(eye_y, 4) as eye_y, round(mouth_x, 4) as mouth_x, round(mouth_y, 4) as mouth_y from stays"""
)
def found_faces(spark, sf_dir: str) -> DataFrame:
    """Faces with landmarks from a detector's outputs, two anchors a photo, through all gates in their order."""
    vectors = X.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 6, 10), lambda x: x.cast("double")).alias("points"))
    raw = _raw(spark, sf_dir).join(vectors, "vec_id").withColumns({"path": F.floor(F.col("vec_id") / 2).cast("string"), "error": F.lit(None).cast("string")})
    found = models.found_faces(raw, replace(Config(), min_face_size=20.0))
    at = lambda k, side: F.round(F.get("keypoints", F.lit(k))[side], 4)
    return found.select("path", F.col("face_ord").cast("long").alias("face_ord"), F.round("confidence", 6).alias("confidence"), *(F.round(c, 4).alias(c) for c in SIDES), at(0, "x").alias("eye_x"), at(0, "y").alias("eye_y"), at(4, "x").alias("mouth_x"), at(4, "y").alias("mouth_y"))


@query(over("select f.path, p.photo_ord, f.face_ord, round(f.confidence::float::double, 4) as confidence, f.x1, f.y1, f.x2, f.y2, round(f.embedding[1]::double, 5) as first_part, f.label::bigint as cluster_id from faces f join photos p on p.path = f.path", "faces", "photos"))
def faces_read_back(spark, sf_dir: str) -> DataFrame:
    """Faces written into the documents of their photos, and flattened out of them again."""
    project = F.lit("p").alias("project_id")
    absent = (F.lit(None).cast(t).alias(c) for c, t in (("aesthetic_score", "float"), ("sharpness_score", "float"), ("grade_reason", "string")))
    photos = X.photos(spark, sf_dir).select(project, "*", *absent)
    faces = X.faces(spark, sf_dir).select(project, "path", "face_ord", F.struct(*(F.col(c).cast("float").alias(c) for c in SIDES)).alias("bbox"), F.col("confidence").cast("float").alias("confidence"), "embedding", F.col("label").cast("long").alias("cluster_id"))
    back = projects.photo_documents_as_tables(projects.photo_documents(photos, faces))[1]
    return back.select("path", "photo_ord", F.col("face_ord").cast("long").alias("face_ord"), F.round(F.col("confidence").cast("double"), 4).alias("confidence"), *(F.col(f"bbox.{c}").cast("double").alias(c) for c in SIDES), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first_part"), "cluster_id")


@query(over("select path, photo_ord, grade, grade_source, content_hash, graded_at, faces_detected_at from photos", "photos"))
def photos_read_back(spark, sf_dir: str) -> DataFrame:
    """Photos written as documents, without any face, and read from them."""
    photos = X.photos(spark, sf_dir).select(F.lit("p").alias("project_id"), "*", *(F.lit(None).cast(t).alias(c) for c, t in (("aesthetic_score", "float"), ("sharpness_score", "float"), ("grade_reason", "string"))))
    none = spark.createDataFrame([], "project_id string, path string, face_ord int, bbox struct<x1: float, y1: float, x2: float, y2: float>, confidence float, embedding array<float>, cluster_id long")
    back = projects.photo_documents_as_tables(projects.photo_documents(photos, none))[0]
    return back.select("path", "photo_ord", "grade", "grade_source", "content_hash", "graded_at", "faces_detected_at")


@query(over("select path, content_hash from photos p left join labels l on l.doc_id = p.photo_ord where l.doc_id is null or toxic = 1 or quality = 0", "photos"))
def missing_copies(spark, sf_dir: str) -> DataFrame:
    """Photos without a copy of what they hold now: those of older contents, and failed ones, do not count."""
    marks = X.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "photo_ord")
    made = X.photos(spark, sf_dir).join(marks, "photo_ord")
    copies = made.select("path", F.when(F.col("quality") == 0, F.lit("older")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("toxic") == 1, F.lit("failed")).alias("error"))
    return sinks.without_copies(X.photos(spark, sf_dir), copies).select("path", "content_hash")


@query("select c_custkey, greatest(0, least(c_custkey % 20 - 3, 11)) as back, greatest(0, least(c_custkey % 20 + 3, 11)) as forth from customer")
def moved_places(spark, sf_dir: str) -> DataFrame:
    """Places in a list of twelve, moved by three either way."""
    place, count = F.col("c_custkey") % 20, F.lit(12).cast("long")
    return X.table(spark, sf_dir, "customer").select("c_custkey", views.moved(place, -3, count).alias("back"), views.moved(place, 3, count).alias("forth"))


@query(over("select path, grade from photos", "photos"))
def view_everyone(spark, sf_dir: str) -> DataFrame:
    """The collection as it is shown while no person is chosen."""
    return views.of_person(X.photos(spark, sf_dir), X.faces(spark, sf_dir), None).select("path", "grade")


@query(over("select count(*) as n_new from files where path not in (select path from stored)", "files", "stored"))
def new_count(spark, sf_dir: str) -> DataFrame:
    return diff.new_files(X.files(spark, sf_dir), X.stored(spark, sf_dir)).agg(F.count("*").alias("n_new"))


@query(over("select count(*) > 0 as can_all, count(*) filter (grade in ('Ok', 'Good', 'Ungraded')) > 0 as can_ok_and_good, count(*) filter (grade = 'Good') > 0 as can_good, count(*) filter (grade = 'Bad') > 0 as can_trash from photos", "photos"))
def export_enabled(spark, sf_dir: str) -> DataFrame:
    """Which exports have anything to copy."""
    counts = export.export_counts(X.photos(spark, sf_dir))
    return counts.select(*((F.col(n) > 0).alias(n.replace("n_", "can_")) for n in ("n_all", "n_ok_and_good", "n_good")), (F.col("n_trash") > 0).alias("can_trash"))
