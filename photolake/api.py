"""What a user of a photo collection calls."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future

from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photolake import schema as S
from photolake.config import Config
from photolake.errors import ImageFailure, NotFound, StorageFailure
from photolake.functions import exif, grading, images
from photolake.operators import clustering, diff, enrichment, export, failures, identity, manual, models, people, sketches, totals, views
from photolake.operators.order import in_time_order
from photolake.sources import photos as sources
from photolake.sources import projects, sinks
from photolake.storage import exists, materialize

#: Rows that a run adds part by part, until they are taken over into the tables at its end.
GRADES = "path string, content_hash string, new_grade string, new_score float, new_sharpness float, new_reason string, now long"
SEARCHED = "path string, content_hash string, now long"
FOUND = T.StructType([*S.FACES, T.StructField("content_hash", T.StringType())])

HEADERS = f"path string, content_hash string, {exif.HEADER}".replace("taken string", "taken timestamp_ntz")
#: Faces that people had when they were last seen; a person's id is the ``cluster_id`` of faces.
MEMBERS = "path string, face_ord int, person_id long"
#: What became of photos at the stages ``grading`` and ``faces``; no error: it went well after a failure.
FAILURES = "path string, content_hash string, stage string, error string, at long"
SKETCHES = "part int, mark decimal(38,0), n long, distinct_sketch binary, quantile_sketch binary"

Report = Callable[[str, DataFrame], None]


class Library:
    """Photo projects kept below a folder.

    Photos and faces are tables; grades set by hand, and names of people, are rows of their own that
    are laid over them when they are read, so no run overwrites them and none has to wait for another.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, models_: tuple[str, str] = ("", "")) -> None:
        self.spark, self.config = spark, config or Config()
        self.store, self.models = projects.Store(spark, root), models_

    def list_projects(self) -> DataFrame:
        return self.store.read_all("projects", projects.PROJECTS)

    def get_project(self, project: str) -> DataFrame:
        found = self.list_projects().where(F.col("project_id") == project)
        if found.isEmpty():
            raise NotFound(project)
        return found

    def import_folder(self, folder: str, name: str | None = None) -> str:
        """A new project of a folder's images; the same folder may be imported again."""
        if not exists(self.spark, folder, folder=True):
            raise NotFound(folder)
        files = sources.scanned(self.spark, folder, self.config)
        project = str(uuid.uuid4())
        self._save_photos(self._as_photos(diff.as_new_photos(files), project), project)
        row = self.spark.createDataFrame([(project, name or folder.rstrip("/").rsplit("/", 1)[-1], folder)], projects.PROJECTS)
        self.store.append(row, "projects")
        self._read_headers(project)
        return project

    def open_project(self, project: str) -> int:
        """Take over what changed in the project's folder; how many photos are new, none if it is gone."""
        folder = self.get_project(project).first()["source_dir"]
        if not exists(self.spark, folder, folder=True):
            return 0
        files = sources.scanned(self.spark, folder, self.config)
        stored, faces = self._stored(project), self._stored_faces(project)
        changes = diff.changed(stored, files)
        new = diff.new_files(files, stored).count()
        if new or not changes.isEmpty():
            self.store.write(diff.drop_changed_faces(faces, changes), "faces", project)
            self.store.write(diff.drop_changed_faces(self.store.read("members", project, MEMBERS), changes), "members", project)
            self._save_photos(self._as_photos(diff.merged(stored.drop("photo_ord"), files), project), project)
            self._read_headers(project)
        return new

    def photos(self, project: str) -> DataFrame:
        """All photos, grades set by hand laid over the others."""
        edits = self.store.read_all("edits", projects.EDITS).where(F.col("project_id") == project)
        return manual.with_manual_grades(self._stored(project), manual.latest_edits(edits))

    def faces(self, project: str) -> DataFrame:
        """All faces, with the place that their photo has now; a rescan may have moved it."""
        now = self._stored(project).select("path", "photo_ord")
        return self._stored_faces(project).drop("photo_ord").join(now, "path").select(*S.FACES.names)

    def clusters(self, project: str) -> DataFrame:
        """People, groups and landscapes as they are now."""
        found = people.summary(self.photos(project), self._flat_faces(project))
        names = self.store.read_all("names", projects.NAMES).where(F.col("project_id") == project)
        return manual.renamed_clusters(found, names.groupBy("cluster_id").agg(F.max_by("new_label", "version").alias("new_label")))

    def has_clusters(self, project: str) -> bool:
        return not self.clusters(project).isEmpty()

    def view(self, project: str, cluster_id: int | None = None) -> DataFrame:
        return views.of_person(self.photos(project), self._flat_faces(project), cluster_id)

    def update_grade(self, project: str, path: str, grade: str) -> None:
        """Set a photo's grade by hand."""
        if grade not in (S.UNGRADED, S.BAD, S.OK, S.GOOD):
            raise ValueError(grade)
        if views.by_path(self._stored(project), path).isEmpty():
            raise NotFound(path)
        self.store.append(self.spark.createDataFrame([(project, path, grade, time.time_ns())], projects.EDITS), "edits")

    def rename_person(self, project: str, cluster_id: int, label: str) -> None:
        self.store.append(self.spark.createDataFrame([(project, cluster_id, label, time.time_ns())], projects.NAMES), "names")

    def check_models(self) -> bool:
        return models.available(*self.models)

    def start_enrichment(self, project: str, report: Report | None = None, now: int | None = None) -> DataFrame:
        """Grade what has no grade, find faces where none were looked for, and group them; the progress afterwards.

        Photos are taken in parts of ``config.part_photos``, and what came of each part is kept at once,
        so a run that fails goes on from there. ``report`` is told ``photo_graded`` with ``path, grade,
        grade_source`` of each part, ``grading`` and ``faces`` with the progress before and after these
        stages, and ``complete`` at the end, also of a run that fails. Photos that failed before are
        taken again when their time has come (:meth:`failures`).
        """
        now = int(time.time()) if now is None else now
        self.get_project(project)
        told = report or (lambda stage, rows: None)
        try:
            self._take_over(project)
            self._try_again(project, now)
            self._grade(project, now, told)
            if self.check_models():
                self._find_faces(project, now, told)
        finally:
            told("complete", views.progress(self._stored(project)))
        return views.progress(self.photos(project))

    def failures(self, project: str) -> DataFrame:
        """``path, stage, error, attempts, last, next_at`` of files, as they are now, that could not be graded or searched.

        They are tried again from ``next_at`` on, after a time that doubles with each attempt; null: no more.
        A file that is changed begins anew.
        """
        c = self.config
        log = self.store.read_all("failures", FAILURES, project).join(self._stored(project).select("path", "content_hash"), ["path", "content_hash"], "left_semi")
        found = failures.still_failing(log, "path", "content_hash", "stage", wait=c.retry_seconds, longest=c.retry_longest, most=c.retry_attempts)
        return found.drop("content_hash")

    def _try_again(self, project: str, now: int) -> None:
        """Let photos whose next attempt is due wait for their stage again."""
        due = self.failures(project).where(F.col("next_at") <= now).groupBy("path").agg(*(F.max(F.col("stage") == s).alias(f"_{s}") for s in ("grading", "faces")))
        due = materialize(due, "due")
        if due.isEmpty():
            return
        both = self._stored(project).join(due, "path", "left")
        again = {c: F.when(~F.coalesce(f"_{s}", F.lit(False)), F.col(c)) for c, s in (("graded_at", "grading"), ("faces_detected_at", "faces"))}
        self._save_photos(both.withColumns(again), project)

    def _note(self, project: str, stage: str, tried: DataFrame, errors: DataFrame, now: int) -> None:
        """Keep what failed at a stage, and what had failed before and went well now."""
        log = self.store.read_all("failures", FAILURES, project).where(F.col("stage") == stage)
        rows = failures.outcomes(tried, errors, log, "path", "content_hash")
        rows = materialize(rows.select("path", "content_hash", F.lit(stage).alias("stage"), "error", F.lit(now).cast("long").alias("at")), "outcomes")
        if not rows.isEmpty():
            self.store.append(rows, "failures", project)

    def grade_totals(self, project: str) -> DataFrame:
        """Photos by ``grade, grade_source, cluster_id`` with subtotals and ``grouping_id``; all without a person too."""
        on = self._stored_faces(project).where("cluster_id is not null").select("path", "cluster_id").distinct()
        rows = self.photos(project).join(on, "path", "left").select("path", "grade", "grade_source", "cluster_id")
        sets = [*totals.rollup_sets("grade", "grade_source", "cluster_id"), ["cluster_id"]]
        return totals.subtotals(rows, ["grade", "grade_source", "cluster_id"], sets, photos=F.count_distinct("path"))

    def statistics(self, project: str, *shares: float) -> DataFrame:
        """``n, n_distinct, quantiles``: photos, different contents and quantiles of sharpness, by sketches.

        Sketches are kept, and only parts of the project that changed are read into new ones.
        """
        kept = self.store.read("sketches", project, SKETCHES)
        rows = self._stored(project).select("path", "content_hash", "sharpness_score")
        now = self.store.write(sketches.refreshed(rows, kept, "path", "content_hash", "sharpness_score", self.config.sketch_parts), "sketches", project)
        return sketches.read(sketches.united(now), *(shares or (0.05, 0.5, 0.95)))

    def enrich_in_background(self, project: str, report: Report | None = None, now: int | None = None) -> Future:
        """Make the small copies, then run :meth:`start_enrichment`, without keeping the caller waiting."""
        done: Future = Future()

        def run() -> None:
            try:
                self.generate_thumbnails(project, report)
                done.set_result(self.start_enrichment(project, report, now))
            except BaseException as x:  # handed to whoever asks for the result
                done.set_exception(x)

        InheritableThread(target=run, daemon=True).start()
        return done

    def polled(self, project: str, seconds: float | None = None, failures: int = 5) -> Iterator[DataFrame]:
        """Photos that changed since the last look, all at first, until no photo waits for a stage.

        A photo changed if its grade, the number of its faces or one of its times did. A look that fails,
        as when a table is being replaced, is passed over; after ``failures`` in a row the error is raised.
        """
        seconds, held, failed = self.config.poll_seconds if seconds is None else seconds, None, 0
        while True:
            try:
                seen = materialize(views.with_face_counts(self.photos(project), self._stored_faces(project)), "seen")
            except PySparkException:
                failed += 1
                if failed >= failures:
                    raise
                time.sleep(seconds)
                continue
            failed = 0
            yield seen if held is None else diff.updated(held, seen, "grade", "n_faces", "graded_at", "faces_detected_at")
            if views.progress(seen).first()["stage"] == "complete":
                return
            held = seen
            time.sleep(seconds)

    def _parts(self, rows: DataFrame) -> Iterator[DataFrame]:
        """``rows`` with a ``path`` in parts of about ``config.part_photos``, by a hash of the path."""
        n = -(-rows.count() // self.config.part_photos)
        for i in range(n):
            yield rows.where(F.pmod(F.xxhash64("path"), F.lit(n)) == i)

    def _pixels(self, project: str, part: DataFrame) -> DataFrame | None:
        """The decoded pictures of a part, whose size is bounded, upright; no other file is read."""
        turns = self.headers(project).where("orientation > 1").select("path", "orientation")
        rows = [(r["path"], r["orientation"]) for r in part.select("path").join(turns, "path", "left").collect()]
        straight, others = [p for p, o in rows if o is None], [(p, o) for p, o in rows if o is not None]
        found = sources.decoded(self.spark, straight) if straight else None
        if others:
            kinds = self.spark.createDataFrame(others, "path string, orientation int")
            turned = images.turned(sources.decoded(self.spark, [p for p, _ in others]).join(kinds, "path"))
            found = turned if found is None else found.unionByName(turned)
        return found

    def headers(self, project: str) -> DataFrame:
        """What cameras wrote into the project's files as they are now (:data:`photolake.functions.exif.HEADER`)."""
        here = self._stored(project).select("path", "content_hash")
        return self.store.read_all("headers", HEADERS, project).join(here, ["path", "content_hash"]).dropDuplicates(["path"]).drop("content_hash")

    def by_time(self, project: str) -> DataFrame:
        """All photos with their headers and places in the order of the time that they were taken."""
        return in_time_order(self.photos(project), self.headers(project))

    def _read_headers(self, project: str) -> None:
        """Read the headers of files whose content has none yet, part by part."""
        stored = self._stored(project).select("path", "content_hash").where("content_hash is not null")
        missing = materialize(stored.join(self.store.read_all("headers", HEADERS, project), ["path", "content_hash"], "left_anti"), "missing")
        for part in self._parts(missing):
            paths = [r["path"] for r in part.select("path").collect()]
            if paths:
                found = sources.headers(self.spark, paths, self.config).join(part, "path")
                self.store.append(found.select(*(c.split()[0] for c in HEADERS.split(", "))), "headers", project)

    def _take_over(self, project: str) -> None:
        """Bring what runs have added into the tables of photos and faces."""
        grades = self.store.read_all("grades", GRADES, project)
        searched = self.store.read_all("searched", SEARCHED, project)
        if grades.isEmpty() and searched.isEmpty():
            return
        stored = self._stored(project)
        here = stored.select("path", "content_hash")
        grades, searched = (x.join(here, ["path", "content_hash"], "left_semi") for x in (grades, searched))
        seen = searched.groupBy("path").agg(F.min("now").alias("seen"))
        if not seen.isEmpty():
            found = self.store.read_all("found", FOUND, project).join(here, ["path", "content_hash"], "left_semi")
            # a part that was run again has added its faces twice
            found = found.select(*S.FACES.names).dropDuplicates(["path", "face_ord"])
            faces = self._stored_faces(project).join(seen, "path", "left_anti").unionByName(found)
            self.regroup(project, self.store.write(faces, "faces", project))
        graded = enrichment.with_grades(stored, grades.drop("content_hash").dropDuplicates(["path"]).withColumn("error", F.lit(None)))
        both = graded.join(seen, "path", "left").withColumn("faces_detected_at", F.coalesce("faces_detected_at", "seen"))
        self._save_photos(both, project)
        for table in ("grades", "searched", "found"):
            self.store.drop(table, project)

    def _grade(self, project: str, now: int, told: Report) -> None:
        """Grade what waits, by its thumbnail where there is one that opens, else by the file itself."""
        waiting = materialize(self.photos(project).where(grading.needs_grading(F.col("graded_at"), F.col("grade_source"))).select("path", "content_hash"), "waiting")
        if waiting.isEmpty():
            return

        def keep(measures: DataFrame, part: DataFrame) -> None:
            names = [c.split()[0] for c in GRADES.split(", ")]
            grades = materialize(enrichment.graded(measures, now, self.config).join(part, "path").select(*names, "error"), "graded")
            self._note(project, "grading", grades, grades, now)
            self.store.append(grades.select(*names), "grades", project)
            graded = grades.where("new_grade is not null").select("path", F.col("new_grade").alias("grade"), F.lit(S.AUTO).alias("grade_source"))
            # a part may hold pictures alone that do not open
            if not graded.isEmpty():
                told("photo_graded", graded)

        told("grading", views.progress(self._stored(project)))
        small = self.store.read_all("copies", sinks.COPIES, project).where("kind = 'thumbnail' and error is null")
        small = small.join(waiting, ["path", "content_hash"], "left_semi").dropDuplicates(["path", "content_hash"])
        measured = materialize(images.measured(sinks.opened(small), self.config).where("error is null"), "measured")
        if not measured.isEmpty():
            keep(measured, waiting)
        for part in self._parts(waiting.join(measured.select("path"), "path", "left_anti")):
            pixels = self._pixels(project, part)
            if pixels is not None:
                # a file that no reader takes for a picture is marked as seen as well
                found = part.select("path").join(images.measured(pixels, self.config), "path", "left")
                keep(found.withColumn("error", F.coalesce("error", F.when(F.col("sharpness").isNull(), F.lit(f"{ImageFailure.prefix}no picture")))), part)
        self._take_over(project)
        told("grading", views.progress(self._stored(project)))

    def _find_faces(self, project: str, now: int, told: Report) -> None:
        """Look for faces where none were looked for, and group all of them anew."""
        waiting = materialize(self._stored(project).where(grading.needs_detection(F.col("faces_detected_at"))).select("path", "content_hash", "photo_ord"), "waiting")
        told("faces", views.progress(self._stored(project)))
        for part in self._parts(waiting):
            pixels = self._pixels(project, part)
            if pixels is None:
                continue
            # the detector runs once; the embedder and the table both read what it found
            raw = materialize(models.raw_detections(pixels, self.models[0], self.config), "anchors")
            found = materialize(models.found_faces(raw, self.config), "found")
            vectors = materialize(models.embedded(pixels, found, self.models[1]), "vectors")
            errors = raw.select("path", "error").unionByName(vectors.select("path", "error"))
            self._note(project, "faces", part, errors.join(part, "path"), now)
            vectors = vectors.where("error is null").drop("error")
            box = F.struct(*(F.col(c).cast("float").alias(c) for c in ("x1", "y1", "x2", "y2")))
            rows = found.join(vectors, ["path", "face_ord"]).join(part, "path")
            new = rows.select(F.lit(project).alias("project_id"), "path", "photo_ord", F.col("face_ord").cast("int").alias("face_ord"), box.alias("bbox"), F.col("confidence").cast("float").alias("confidence"), "embedding", F.lit(None).cast("long").alias("cluster_id"), "content_hash")
            self.store.append(new, "found", project)
            self.store.append(part.select("path", "content_hash", F.lit(now).cast("long").alias("now")), "searched", project)
        self._take_over(project)
        told("faces", views.progress(self._stored(project)))

    def regroup(self, project: str, faces: DataFrame | None = None) -> None:
        """Cluster all faces of a project anew, in the order of photos as they stand now.

        A ``cluster_id`` stays with a person (:mod:`photolake.operators.identity`), and with it the name:
        the cluster that shares most faces with the person has it, whatever its number in the grouping.
        """
        now = self._stored(project).select("path", "photo_ord")
        faces = (self._stored_faces(project) if faces is None else faces).drop("photo_ord").join(now, "path")
        # a photo's place is its own, and a photo has far fewer faces
        keyed = faces.withColumn("ord", F.col("photo_ord") * 1_000_000 + F.col("face_ord"))
        labels = clustering.dbscan(keyed.where("embedding is not null").select("ord", "embedding"), self.config.cluster_eps, self.config.cluster_min_samples)
        of = materialize(keyed.select("path", "face_ord", "ord").join(labels.select("ord", "cluster_id"), "ord").drop("ord"), "grouped")
        members = self.store.read("members", project, MEMBERS)
        who = materialize(identity.lasting(members, of, "path", "face_ord"), "people")
        self.store.write(identity.remembered(members, of, who, "path", "face_ord"), "members", project)
        of = of.join(who.select("cluster_id", "person_id"), "cluster_id", "left").select("path", "face_ord", F.col("person_id").alias("cluster_id"))
        self.store.write(faces.drop("cluster_id").join(of, ["path", "face_ord"], "left").select(*S.FACES.names), "faces", project)

    def generate_thumbnails(self, project: str, report: Report | None = None) -> int:
        """Make the copies that are missing, part by part; for how many photos there are copies now.

        ``report`` is told ``thumbnails`` with ``done, total`` after each part.
        """
        self.get_project(project)
        stored = self._stored(project)
        missing = materialize(sinks.without_copies(stored, self.store.read_all("copies", sinks.COPIES, project)).select("path", "content_hash"), "missing")
        total, left = stored.count(), missing.count()
        done = total - left
        for part in self._parts(missing):
            pixels, n = self._pixels(project, part), part.count()
            if pixels is not None:
                self.store.append(sinks.small_copies(pixels.join(part, "path"), self.config), "copies", project)
            done += n
            if report:
                report("thumbnails", self._told_so_far(done, total))
        return self.store.read_all("copies", sinks.COPIES, project).where("error is null and kind = 'thumbnail'").join(stored, ["path", "content_hash"], "left_semi").select("path").distinct().count()

    def get_thumbnail(self, project: str, filename: str, kind: str = "thumbnail") -> bytes:
        of = self._stored(project).where(F.col("filename") == filename).select("path", "content_hash")
        row = self.store.read_all("copies", sinks.COPIES, project).where((F.col("kind") == kind) & F.col("error").isNull()).join(of, ["path", "content_hash"], "left_semi").first()
        if row is None:
            raise NotFound(filename)
        return bytes(row["png"])

    def _told_so_far(self, done: int, total: int) -> DataFrame:
        return self.spark.range(1).select(F.lit(done).cast("long").alias("done"), F.lit(total).cast("long").alias("total"))

    def can_export(self, project: str, which: str = "All") -> bool:
        """Whether the grade filter passes any photo."""
        return not self.photos(project).where(grading.exported(F.col("grade"), which)).isEmpty()

    def export_photos(self, project: str, folder: str, which: str = "All", by_person: bool = False, everyone: bool = False, trash_bad: bool = False, report: Report | None = None) -> int:
        """Copy the chosen photos, then move bad ones to the trash folder; how many were chosen.

        ``report`` is told ``export`` with ``done, total`` after each part. A file that cannot be copied
        is an error, and no further part is copied; one that cannot be moved is not.
        """
        chosen, faces = self.photos(project), self._flat_faces(project)
        plan = export.plan_by_person(chosen, faces, people.people(faces), which, folder, everyone) if by_person else export.flat_plan(chosen, which, folder)
        plan = materialize(plan, "plan")
        total, done = plan.count(), 0
        for part in self._parts(plan):
            copied, failed = sinks.apply_plan(part).agg(F.count_if("done"), F.max(F.when(~F.col("done"), F.col("error")))).first()
            if failed is not None:
                raise StorageFailure(failed.removeprefix(StorageFailure.prefix))
            done += copied
            if report:
                report("export", self._told_so_far(done, total))
        if trash_bad:
            sinks.apply_plan(export.trash_plan(chosen), move=True).agg(F.count_if("done")).first()
        return total

    def get_config(self) -> Config:
        return self.config

    def update_config(self, config: Config, path: str | None = None) -> None:
        self.config = config
        if path:
            config.save(path)

    def _stored(self, project: str) -> DataFrame:
        return self.store.read("photos", project, S.PHOTOS)

    def _stored_faces(self, project: str) -> DataFrame:
        return self.store.read("faces", project, S.FACES)

    def _flat_faces(self, project: str) -> DataFrame:
        return self.faces(project).select("*", *(F.col(f"bbox.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))).drop("bbox")

    def _as_photos(self, photos: DataFrame, project: str) -> DataFrame:
        """Rows of the photo table, in order, with columns that are not known yet left null."""
        known = {f.name: f.dataType for f in S.PHOTOS}
        full = photos.withColumn("project_id", F.lit(project)).withColumns({c: F.lit(None).cast(t) for c, t in known.items() if c not in (*photos.columns, "project_id")})
        return diff.in_order(full.drop("photo_ord")).select(*(F.col(c).cast(t) for c, t in known.items()))

    def _save_photos(self, photos: DataFrame, project: str) -> None:
        self.store.write(photos.select(*S.PHOTOS.names), "photos", project)
