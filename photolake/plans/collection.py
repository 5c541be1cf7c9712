"""Queries over the photo table: rescans, grades, progress, views by place, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions import grading, text
from photolake.operators import diff, export, manual, views
from photolake.plans import fixtures as X
from photolake.plans.catalog import query
from photolake.plans.views import over

PHOTO_COLUMNS = ("path", "filename", "grade", "grade_source", "content_hash")


@query(
    """
    select page_id, ext, name from (
      select page_id, regexp_extract(path, '([^/]*)$', 1) as name, lower(regexp_extract(path, '\\.([^./]+)$', 1)) as ext from (
        select page_id, '/p/' || page_id || case page_id % 6 when 0 then '.jpg' when 1 then '.JPEG' when 2 then '.txt' when 3 then '' when 4 then '.b.Tiff' else '.gif' end as path from pages))
    where ext in ('jpg', 'jpeg', 'png', 'heic', 'tif', 'tiff')
    """
)
def ext_filter(spark, sf_dir: str) -> DataFrame:
    """Files whose extension is an image's, in any case."""
    ends = F.element_at(F.array(*(F.lit(e) for e in (".jpg", ".JPEG", ".txt", "", ".b.Tiff", ".gif"))), (F.col("page_id") % 6 + 1).cast("int"))
    p = X.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/p/"), F.col("page_id").cast("string"), ends).alias("path"))
    return p.where(text.is_image(F.col("path"))).select("page_id", text.extension(F.col("path")).alias("ext"), text.basename(F.col("path")).alias("name"))


@query(over("select path, content_hash from files", "files"))
def content_hash(spark, sf_dir: str) -> DataFrame:
    return X.files(spark, sf_dir).select("path", "content_hash")


@query(over("select path, filename, 'Ungraded' as grade, 'Unset' as grade_source, content_hash from files where path not in (select path from stored)", "files", "stored"))
def new_photos(spark, sf_dir: str) -> DataFrame:
    return diff.as_new_photos(diff.new_files(X.files(spark, sf_dir), X.stored(spark, sf_dir)))


@query(over("select path, grade from stored where path in (select path from files)", "stored"))
def surviving_photos(spark, sf_dir: str) -> DataFrame:
    return diff.surviving(X.stored(spark, sf_dir), X.files(spark, sf_dir)).select("path", "grade")


@query(over("select path, grade from stored where path not in (select path from files)", "stored"))
def missing_photos(spark, sf_dir: str) -> DataFrame:
    return diff.missing(X.stored(spark, sf_dir), X.files(spark, sf_dir)).select("path", "grade")


@query(over("select s.path, f.content_hash as new_hash from stored s join files f on f.path = s.path where f.content_hash is not null and s.content_hash is distinct from f.content_hash", "stored"))
def changed_photos(spark, sf_dir: str) -> DataFrame:
    return diff.changed(X.stored(spark, sf_dir), X.files(spark, sf_dir))


RESET = """
    select s.path, s.filename, case when h and s.grade_source <> 'Manual' then 'Ungraded' else s.grade end as grade,
      case when h and s.grade_source <> 'Manual' then 'Unset' else s.grade_source end as grade_source,
      case when h then new_hash else s.content_hash end as content_hash,
      case when h and s.grade_source <> 'Manual' then null else s.graded_at end as graded_at, case when h then null else s.faces_detected_at end as faces_detected_at
    from (select s.*, f.content_hash as new_hash, f.content_hash is not null and s.content_hash is distinct from f.content_hash as h from stored s left join files f on f.path = s.path) s
"""


@query(over(RESET, "stored"))
def change_reset(spark, sf_dir: str) -> DataFrame:
    """Photos of changed files lose what was found automatically."""
    photos = X.stored(spark, sf_dir)
    return diff.reset_changed(photos, diff.changed(photos, X.files(spark, sf_dir)))


@query(over(RESET + " union all select path, filename, 'Ungraded', 'Unset', content_hash, null, null from files where path not in (select path from stored)", "stored"))
def rescan(spark, sf_dir: str) -> DataFrame:
    """The whole photo table after a rescan."""
    return diff.merged(X.stored(spark, sf_dir), X.files(spark, sf_dir))


@query(over("select path, row_number() over (order by filename, path) - 1 as photo_ord from photos", "photos"))
def photo_order(spark, sf_dir: str) -> DataFrame:
    return diff.in_order(X.photos(spark, sf_dir).drop("photo_ord")).select("path", "photo_ord")


@query(over("select path from photos where graded_at is null and grade_source <> 'Manual'", "photos"))
def needs_grading(spark, sf_dir: str) -> DataFrame:
    return X.photos(spark, sf_dir).where(grading.needs_grading(F.col("graded_at"), F.col("grade_source"))).select("path")


@query(over("select path from photos where faces_detected_at is null", "photos"))
def needs_detection(spark, sf_dir: str) -> DataFrame:
    return X.photos(spark, sf_dir).where(grading.needs_detection(F.col("faces_detected_at"))).select("path")


@query(
    over(
        """select to_grade, to_detect, total, case when to_grade > 0 then 'grading' when to_detect > 0 then 'faces' else 'complete' end as stage from (
        select count(*) filter (graded_at is null and grade_source <> 'Manual') as to_grade, count(*) filter (faces_detected_at is null) as to_detect, count(*) as total from photos)""",
        "photos",
    )
)
def progress(spark, sf_dir: str) -> DataFrame:
    return views.progress(X.photos(spark, sf_dir))


@query(over("select count(*) filter (grade = 'Bad') as bad, count(*) filter (grade = 'Ok') as ok, count(*) filter (grade = 'Good') as good, count(*) filter (grade not in ('Bad', 'Ok', 'Good')) as ungraded, count(*) as total from photos", "photos"))
def grade_counts(spark, sf_dir: str) -> DataFrame:
    return views.grade_counts(X.photos(spark, sf_dir))


@query(over("select count(*) as n_all, count(*) filter (grade in ('Ok', 'Good', 'Ungraded')) as n_ok_and_good, count(*) filter (grade = 'Good') as n_good, count(*) filter (grade = 'Bad') as n_trash from photos", "photos"))
def export_counts(spark, sf_dir: str) -> DataFrame:
    return export.export_counts(X.photos(spark, sf_dir))


@query(over("select path, '/out/' || filename as dest from photos where grade in ('Ok', 'Good', 'Ungraded')", "photos"))
def export_plan_flat(spark, sf_dir: str) -> DataFrame:
    return export.flat_plan(X.photos(spark, sf_dir), "OkAndGood", "/out/")


@query(over("select path, '/p/_trash/' || filename as dest from photos where grade = 'Bad'", "photos"))
def trash_plan(spark, sf_dir: str) -> DataFrame:
    return export.trash_plan(X.photos(spark, sf_dir))


@query(
    over(
        """select path, row_number() over w as place, count(*) over () as "of", coalesce(lag(path) over w, path) as previous, coalesce(lead(path) over w, path) as next
        from photos window w as (order by filename, path)""",
        "photos",
    )
)
def navigation(spark, sf_dir: str) -> DataFrame:
    """Place and neighbours of every photo in the order of file names."""
    return views.navigation(X.photos(spark, sf_dir))


@query(over("select path, grade, content_hash from photos where path = '/p/IMG_17.jpg'", "photos"))
def photo_by_path(spark, sf_dir: str) -> DataFrame:
    return views.by_path(X.photos(spark, sf_dir), "/p/IMG_17.jpg").select("path", "grade", "content_hash")


@query(over("select path from (select path, row_number() over (order by filename, path) - 1 as i from photos) where i = 20", "photos"))
def photo_at(spark, sf_dir: str) -> DataFrame:
    """The photo that stands at a place of the list."""
    return views.at_place(X.photos(spark, sf_dir), 20).select("path")


#: Hand-made edits: every labelled document was edited once for quality, a quarter again later.
EDITS = """edits as (select '/p/IMG_' || doc_id || '.jpg' as path, case when quality = 1 then 'Good' else 'Bad' end as grade, 1::bigint as version from labels
    union all select '/p/IMG_' || doc_id || '.jpg', 'Ok', 2 from labels where doc_id % 4 = 0)"""


def _edits(spark, sf_dir: str) -> DataFrame:
    marks = X.table(spark, sf_dir, "labels")
    path = F.concat(F.lit("/p/IMG_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path")
    first = marks.select(path, F.when(F.col("quality") == 1, F.lit("Good")).otherwise(F.lit("Bad")).alias("grade"), F.lit(1).cast("long").alias("version"))
    return first.unionByName(marks.where("doc_id % 4 = 0").select(path, F.lit("Ok").alias("grade"), F.lit(2).cast("long").alias("version")))


@query(over(f"select p.path, coalesce(e.grade, p.grade) as grade, case when e.grade is not null then 'Manual' else p.grade_source end as grade_source from photos p left join (with {EDITS} select path, arg_max(grade, version) as grade from edits group by path) e on e.path = p.path", "photos"))
def manual_grades(spark, sf_dir: str) -> DataFrame:
    """The photo table with the last edit of each photo laid over it."""
    return manual.with_manual_grades(X.photos(spark, sf_dir), manual.latest_edits(_edits(spark, sf_dir))).select("path", "grade", "grade_source")


@query(f"with {EDITS} select path, before, grade, version from (select path, lag(grade) over (partition by path order by version) as before, grade, version from edits) where before <> grade")
def grade_edits_changed(spark, sf_dir: str) -> DataFrame:
    """Edits that gave a photo another grade than the one before."""
    return views.changed_values(_edits(spark, sf_dir), "path", "grade", "version").select("path", "before", "grade", "version")


@query(over("select n.path, n.grade, n.graded_at from photos n left join stored s on s.path = n.path left join (select path, count(*) as n_faces from faces group by path) f on f.path = n.path where s.path is null or s.grade is distinct from n.grade or s.graded_at is distinct from n.graded_at or s.faces_detected_at is distinct from n.faces_detected_at or coalesce(n_faces, 0) > 0", "photos", "stored", "faces"))
def poll_changes(spark, sf_dir: str) -> DataFrame:
    """What a viewer that holds the stored table has to take over from the current one."""
    faces = X.faces(spark, sf_dir)
    before, now = views.with_face_counts(X.stored(spark, sf_dir), faces.limit(0)), views.with_face_counts(X.photos(spark, sf_dir), faces)
    return diff.updated(before, now, "grade", "n_faces", "graded_at", "faces_detected_at").select("path", "grade", "graded_at")


@query("select c_custkey, c_custkey || case when c_custkey = 1 then ' photo' else ' photos' end as counted, upper(c_name[1]) as letter, case when c_nationkey > 0 then round(c_custkey % 7 * 100.0 / c_nationkey, 6) else 0 end::double as share, case when c_mktsegment like 'BUILD%' or c_mktsegment like 'AUTO%' then 'downloading' else c_mktsegment end as stage from customer")
def display_texts(spark, sf_dir: str) -> DataFrame:
    """Counts, initials, shares and stage names as a viewer shows them."""
    c = X.table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    named = F.when(segment.startswith("BUILD"), F.lit("Download")).when(segment.startswith("AUTO"), F.lit("Extract")).otherwise(segment)
    return c.select("c_custkey", text.plural(F.col("c_custkey"), "photo").alias("counted"), text.initial(F.col("c_name")).alias("letter"), F.round(text.percent(F.col("c_custkey") % 7, F.col("c_nationkey")), 6).alias("share"), text.stage(named).alias("stage"))
