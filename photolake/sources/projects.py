"""Projects: tables of photos, faces and hand-made edits, and the JSON documents of older versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photolake import schema as S

PROJECTS = "project_id string, name string, source_dir string"
EDITS = "project_id string, path string, grade string, version long"
NAMES = "project_id string, cluster_id long, new_label string, version long"

#: Ids that older documents give to the two virtual clusters, as they were written by either side.
LEGACY_GROUPS, LEGACY_LANDSCAPES = ("18446744073709551613", "9007199254740990"), ("18446744073709551614", "9007199254740989")


class Store:
    """Versioned Parquet tables below a folder.

    A table of a project is written whole as a new version and becomes visible when its success marker
    is there, so a reader never meets half a table and a failed write leaves the old one in place.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, table: str, project: str) -> list[int]:
        folder = self._path(f"{self.root}/{table}/{project}")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def _complete(self, table: str, project: str) -> str | None:
        for v in reversed(self._versions(table, project)):
            path = f"{self.root}/{table}/{project}/v{v}"
            if self._fs.exists(self._path(f"{path}/_SUCCESS")):
                return path
        return None

    def write(self, df: DataFrame, table: str, project: str, keep: int = 2) -> DataFrame:
        """Write a new version and return it; all but the last ``keep`` go."""
        versions = self._versions(table, project)
        new = f"{self.root}/{table}/{project}/v{(versions or [0])[-1] + 1}"
        df.write.option("compression", "zstd").parquet(new)
        for v in versions[: max(0, len(versions) + 1 - keep)]:
            self._fs.delete(self._path(f"{self.root}/{table}/{project}/v{v}"), True)
        return self.spark.read.schema(df.schema).parquet(new)

    def append(self, df: DataFrame, table: str, project: str = "all") -> None:
        """Add rows to a table that is never rewritten, of one project or of all."""
        df.write.mode("append").option("compression", "zstd").parquet(f"{self.root}/{table}/{project}")

    def drop(self, table: str, project: str) -> None:
        """Remove the rows that were added to a table of a project."""
        self._fs.delete(self._path(f"{self.root}/{table}/{project}"), True)

    def read(self, table: str, project: str, schema: T.StructType | str) -> DataFrame:
        """The newest complete version; no rows where there is none."""
        path = self._complete(table, project)
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def read_all(self, table: str, schema: T.StructType | str, project: str = "all") -> DataFrame:
        """All rows that were added; no rows where there are none."""
        path = f"{self.root}/{table}/{project}"
        return self.spark.read.schema(schema).parquet(path) if self._fs.exists(self._path(path)) else self.spark.createDataFrame([], schema)


FACE = "struct<bbox: array<float>, confidence: float, embedding: array<float>, cluster_id: decimal(20,0)>"
PHOTO = f"struct<path: string, filename: string, grade: string, grade_source: string, faces: array<{FACE}>, aesthetic_score: float, sharpness_score: float, grade_reason: string, content_hash: string, graded_at: bigint, faces_detected_at: bigint>"
DOCUMENT = f"id string, name string, source_dir string, photos array<{PHOTO}>, _corrupt string"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Project documents, one JSON file each; files that are no such document are left out."""
    found = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{folder.rstrip('/')}/*.json")
    return found.where("_corrupt is null and id is not null").drop("_corrupt")


def documents_as_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projects, photos and faces of documents; places in lists become numbers."""
    projects = documents.select(F.col("id").alias("project_id"), "name", "source_dir")
    return projects, *_as_tables(documents.select(F.col("id").alias("project_id"), F.posexplode("photos").alias("photo_ord", "p")))


def photo_documents_as_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos and faces of what :func:`photo_documents` wrote; lines that are no such document are left out."""
    rows = lines.select("project_id", "photo_ord", F.from_json("document", PHOTO).alias("p")).where("p.path is not null")
    return _as_tables(rows)


def _as_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    photos = rows.select("project_id", "p.path", "p.filename", F.col("photo_ord").cast("long").alias("photo_ord"), "p.grade", "p.grade_source", "p.aesthetic_score", "p.sharpness_score", "p.grade_reason", "p.content_hash", "p.graded_at", "p.faces_detected_at")
    faces = rows.select("project_id", "p.path", F.col("photo_ord").cast("long").alias("photo_ord"), F.posexplode("p.faces").alias("face_ord", "f"))
    box = F.struct(*(F.get("f.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))
    cluster = F.col("f.cluster_id").cast("string")
    small = F.when(cluster.isin(*LEGACY_GROUPS), F.lit(S.GROUPS_ID)).when(cluster.isin(*LEGACY_LANDSCAPES), F.lit(S.LANDSCAPES_ID)).otherwise(F.expr("try_cast(f.cluster_id as bigint)"))
    return photos, faces.select("project_id", "path", "photo_ord", "face_ord", box.alias("bbox"), "f.confidence", "f.embedding", small.cast("long").alias("cluster_id"))


def photo_documents(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """``project_id, photo_ord, path, document``: each photo with its faces, in order, as one JSON text.

    The older format holds a whole project in one text; here a project is as many lines as photos, so
    that none is gathered in one row. The detector caps a photo's faces.
    """
    face = F.struct("face_ord", F.array("bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2").alias("bbox"), "confidence", "embedding", "cluster_id")
    of = faces.groupBy("project_id", "path").agg(F.sort_array(F.collect_list(face)).alias("faces"))
    bare = F.transform(F.coalesce("faces", F.array()), lambda f: f.dropFields("face_ord"))
    photo = F.struct("path", "filename", "grade", "grade_source", bare.alias("faces"), "aesthetic_score", "sharpness_score", "grade_reason", "content_hash", "graded_at", "faces_detected_at")
    return photos.join(of, ["project_id", "path"], "left").select("project_id", "photo_ord", "path", F.to_json(photo, {"ignoreNullFields": "false"}).alias("document"))
