"""Photos, faces and rasters derived from the supplied tables, for queries without image files.

Documents stand for photos, their text for the content; embeddings for face vectors, and for small
rasters. All rows of the tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake import schema as S
from photolake.functions.text import basename, content_hash
from photolake.operators.detection import capped, confident, large_enough, suppressed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder as it is now: ``photo_ord, path, filename, content_hash``."""
    path = F.concat(F.lit("/p/IMG_"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("photo_ord"), path.alias("path"), "text")
    return d.select("photo_ord", "path", basename(F.col("path")).alias("filename"), content_hash(F.col("text"), 65_536).alias("content_hash"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photo table as it was: labelled documents, some with other or no hashes, and pages that are gone."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("photo_ord"), "quality", "toxic")
    now = files(spark, sf_dir).join(marks, "photo_ord")
    old = F.when(F.col("toxic") == 1, F.lit(None)).when(F.col("quality") == 0, F.sha2(F.concat("content_hash", F.lit("old")), 256)).otherwise(F.col("content_hash"))
    manual = F.col("toxic") == 1
    had = now.select("path", "filename", F.when(manual, F.lit(S.BAD)).otherwise(F.lit(S.GOOD)).alias("grade"), F.when(manual, F.lit(S.MANUAL)).otherwise(F.lit(S.AUTO)).alias("grade_source"), old.alias("content_hash"), F.when(F.col("quality") == 1, F.lit(1000)).cast("long").alias("graded_at"), F.lit(2000).cast("long").alias("faces_detected_at"))
    gone = table(spark, sf_dir, "pages").select(F.concat(F.lit("/p/OLD_"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"))
    gone = gone.select("path", basename(F.col("path")).alias("filename"), F.lit(S.UNGRADED).alias("grade"), F.lit(S.UNSET).alias("grade_source"), F.lit("0").alias("content_hash"), F.lit(None).cast("long").alias("graded_at"), F.lit(None).cast("long").alias("faces_detected_at"))
    return had.unionByName(gone)


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All photos with hand-set grades where labels have them: toxic is bad, good quality is good."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("photo_ord"), "quality", "toxic")
    both = files(spark, sf_dir).join(marks, "photo_ord", "left")
    grade = F.when(F.col("toxic") == 1, F.lit(S.BAD)).when(F.col("quality") == 1, F.lit(S.GOOD)).when(F.col("quality") == 0, F.lit(S.OK)).otherwise(F.lit(S.UNGRADED))
    source = F.when((F.col("toxic") == 1) | (F.col("quality") == 1), F.lit(S.MANUAL)).when(F.col("quality") == 0, F.lit(S.AUTO)).otherwise(F.lit(S.UNSET))
    return both.select("photo_ord", "path", "filename", "content_hash", grade.alias("grade"), source.alias("grade_source"), F.when(F.col("quality") == 0, F.lit(1000)).cast("long").alias("graded_at"), F.when(F.col("quality").isNotNull(), F.lit(2000)).cast("long").alias("faces_detected_at"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected boxes: ``photo_ord, path, face_ord, x1, y1, x2, y2, confidence, embedding, label, vec_id``."""
    i = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings")
    x1, y1 = (i * 37 % 200).cast("double"), (i * 53 % 150).cast("double")
    base = e.select(((i * i * 31 + i * 17) % 150).alias("photo_ord"), i.alias("vec_id"), (((i * 7919) % 1000) / 1000.0).alias("confidence"), x1.alias("x1"), y1.alias("y1"), (x1 + 40 + i * 13 % 160).alias("x2"), (y1 + 40 + i * 29 % 160).alias("y2"), "embedding", "label")
    from pyspark.sql.window import Window

    order = Window.partitionBy("photo_ord").orderBy(F.col("confidence").desc(), "vec_id")
    return base.withColumn("face_ord", F.row_number().over(order) - 1).withColumn("path", F.concat(F.lit("/p/IMG_"), F.col("photo_ord").cast("string"), F.lit(".jpg")))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large_enough(confident(faces(spark, sf_dir), 0.5), 80.0)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces that pass all gates, as they are stored."""
    return capped(suppressed(gated(spark, sf_dir), "photo_ord", 0.4, "vec_id", "path", "label"), "photo_ord", 10).drop("rank")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray pixels, and 21 pixels of colour, from each vector."""
    v = F.transform("embedding", lambda e: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((e.cast("double") * 2 + 0.5) * 255).cast("double"))))
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("gray"))
    rgb = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.struct(F.get("gray", k).alias("r"), F.get("gray", k + 21).alias("g"), F.get("gray", k + 42).alias("b")))
    return e.withColumn("rgb", rgb)
