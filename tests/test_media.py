"""Folders of pictures: import, rescan, grading, detection with a stand-in model, copies, export."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.api import Library, NotFound
from photolake.config import Config
from photolake.operators import models
from photolake.sources import photos, projects, sinks


def save(path, rgb):
    path.write_bytes(sinks.png(np.asarray(rgb, np.uint8)))


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "wedding"
    f.mkdir()
    board = np.kron(np.indices((40, 50)).sum(0) % 2, np.ones((4, 4)))[..., None] * np.array([200, 120, 30]) + 20
    save(f / "a.png", board)
    save(f / "b.PNG", np.full((60, 80, 3), 128))
    save(f / "c.png", np.full((60, 80, 3), 255))
    (f / "d.jpg").write_bytes(b"no picture")
    (f / "notes.txt").write_text("no picture either")
    (f / "below").mkdir()
    save(f / "below" / "e.png", np.zeros((10, 10, 3)))
    return f


@pytest.fixture
def library(spark, tmp_path):
    return Library(spark, f"file://{tmp_path}/library", Config(min_face_size=4.0, max_faces=3))


def grades(library, project):
    return {r.filename: (r.grade, r.grade_source, r.grade_reason) for r in library.photos(project).collect()}


def test_scan_takes_images_of_the_top_folder(spark, folder):
    found = photos.scanned(spark, str(folder)).orderBy("filename").collect()
    assert [r.filename for r in found] == ["a.png", "b.PNG", "c.png", "d.jpg"]
    assert all(len(r.content_hash) == 64 for r in found)
    assert photos.listed(spark, str(folder)).count() == 4


def test_empty_and_hidden_files_are_seen_and_marked(library, folder):
    (folder / "empty.png").write_bytes(b"")
    (folder / "._b.jpg").write_bytes(b"what a copying program leaves")
    project = library.import_folder(str(folder))
    assert library.photos(project).count() == 6
    library.start_enrichment(project, now=5)
    found = {r.filename: (r.grade, r.graded_at) for r in library.photos(project).collect()}
    assert found["empty.png"] == found["._b.jpg"] == found["d.jpg"] == ("Ungraded", 5)
    assert found["b.PNG"][0] != "Ungraded"


def test_decoding_gives_pixels_back(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in photos.decoded(spark, str(folder)).collect()}
    assert rows["d.jpg"].width == -1
    from photolake.functions.images import rgb_of

    a = rgb_of(bytes(rows["a.png"].pixels), rows["a.png"].width, rows["a.png"].height, rows["a.png"].channels)
    assert a.shape == (160, 200, 3) and a[0, 4].tolist() == [220, 140, 50]


def test_enrichment_grades_and_changes_nothing_when_run_again(library, folder):
    project = library.import_folder(str(folder))
    seen = []
    library.start_enrichment(project, lambda stage, p: seen.append(stage), now=77)
    first = grades(library, project)
    assert first["a.png"][0] in ("Ok", "Good") and first["a.png"][2].startswith("Aesthetic score")
    assert first["b.PNG"][0] == "Bad" and first["b.PNG"][2].startswith("Blurry")
    assert first["c.png"][0] == "Bad" and first["c.png"][2].endswith("Overexposed")
    assert first["d.jpg"] == ("Ungraded", "Unset", None)
    assert library.photos(project).where("graded_at = 77").count() == 4
    assert seen[0] == "grading" and seen[-1] == "complete"
    library.start_enrichment(project, now=99)
    assert grades(library, project) == first
    assert library.photos(project).where("graded_at = 99").count() == 0


def test_hand_made_grades_survive_runs_and_changes(library, folder):
    project = library.import_folder(str(folder))
    path = library.photos(project).where("filename = 'b.PNG'").first().path
    library.update_grade(project, path, "Good")
    library.start_enrichment(project, now=5)
    assert grades(library, project)["b.PNG"][:2] == ("Good", "Manual")
    save(folder / "b.PNG", np.zeros((30, 30, 3)))
    save(folder / "n.png", np.zeros((30, 30, 3)))
    assert library.open_project(project) == 1
    assert grades(library, project)["b.PNG"][:2] == ("Good", "Manual")
    assert grades(library, project)["n.png"][0] == "Ungraded"
    with pytest.raises(NotFound):
        library.update_grade(project, "nowhere", "Good")
    with pytest.raises(NotFound):
        library.get_project("none")


def test_changed_files_are_graded_anew(library, folder):
    project = library.import_folder(str(folder))
    library.start_enrichment(project, now=5)
    save(folder / "c.png", np.zeros((60, 80, 3)))
    assert library.open_project(project) == 0
    assert grades(library, project)["c.png"] == ("Ungraded", "Unset", None)
    library.start_enrichment(project, now=6)
    assert grades(library, project)["c.png"][2].endswith("Underexposed")


def test_copies_are_made_once_for_each_content(library, folder):
    project = library.import_folder(str(folder))
    assert library.generate_thumbnails(project) == 3
    png = library.get_thumbnail(project, "a.png")
    assert png[:4] == b"\x89PNG"
    assert library.generate_thumbnails(project) == 3
    with pytest.raises(NotFound):
        library.get_thumbnail(project, "d.jpg")


def test_export_copies_and_moves_bad_ones_to_the_trash(library, folder, tmp_path):
    project = library.import_folder(str(folder))
    library.start_enrichment(project, now=5)
    out = tmp_path / "out"
    assert library.export_photos(project, f"file:{out}", "OkAndGood", trash_bad=True) == 2
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == ["a.png", "d.jpg"]
    assert sorted(p.name for p in (folder / "_trash").iterdir()) == ["b.PNG", "c.png"]
    assert not (folder / "b.PNG").exists()
    assert library.export_photos(project, f"file:{out}", "GoodOnly") in (0, 1)


def fake_outputs(faces):
    """Nine outputs in which ``faces`` (stride, index, score, distances, points) stand and nothing else."""
    out = []
    for width in (1, 4, 10):
        for stride in (8, 16, 32):
            a = np.full((1, (640 // stride) ** 2 * 2, width), -20.0 if width == 1 else 0.0, np.float32)
            for s, i, score, d, p in faces:
                if s == stride:
                    a[0, i] = score if width == 1 else d if width == 4 else p
            out.append(a)
    return out[::-1]


def test_detection_from_outputs_to_faces(spark):
    pixels = np.full((320, 640, 3), 90, np.uint8)
    image = spark.createDataFrame([("p", 640, 320, 3, bytearray(pixels.tobytes())), ("q", -1, -1, -1, bytearray(b""))], "path string, width int, height int, channels int, pixels binary")
    points = [-0.5, -0.5, 0.5, -0.5, 0, 0, -0.4, 0.5, 0.4, 0.5]
    cell = lambda x, y, stride: (y * (640 // stride) + x) * 2
    faces = [(32, cell(5, 9, 32), 2.0, (2, 2, 2, 2), points), (32, cell(5, 9, 32) + 1, 1.0, (2, 2, 2, 2), points), (16, cell(30, 20, 16), 0.5, (3, 3, 3, 3), points), (8, cell(1, 40, 8), -1.0, (9, 9, 9, 9), points)]
    raw = models.raw_detections(image, "", Config(min_face_size=20.0), run=lambda x: fake_outputs(faces))
    found = models.found_faces(raw, Config(min_face_size=20.0)).orderBy("face_ord").collect()
    assert len(found) == 2  # one is suppressed, one is not sure enough
    assert found[0].confidence == pytest.approx(1 / (1 + np.exp(-2)), abs=1e-6)
    # the letterbox puts 160 rows above the picture
    assert (found[0].x1, found[0].y1, found[0].x2, found[0].y2) == pytest.approx((176 - 64, 304 - 160 - 64, 176 + 64, 304 - 160 + 64))
    assert raw.where("error is not null").count() == 1
    vectors = models.embedded(image, models.found_faces(raw, Config(min_face_size=20.0)), "", run=lambda x: x[:, :, ::16, ::16].reshape(1, -1) + 0.3)
    rows = vectors.collect()
    assert len(rows) == 2 and all(abs(sum(v * v for v in r.embedding) - 1) < 1e-4 for r in rows)
    with pytest.raises(ValueError):
        models.split_outputs([np.zeros((1, 5, 3))] * 9)
    assert not models.available("/nowhere.onnx", "/nor/here.onnx")


def test_documents_of_older_versions(spark, tmp_path):
    import json

    face = {"bbox": [1, 2, 3, 4], "confidence": 0.9, "embedding": [0.6, 0.8], "cluster_id": 2**64 - 3}
    photo = {"path": "/x/a.jpg", "filename": "a.jpg", "grade": "Good", "grade_source": "Manual", "faces": [face, face | {"cluster_id": 4}, face | {"cluster_id": None}], "aesthetic_score": None, "sharpness_score": 12.5, "grade_reason": None, "content_hash": "00", "graded_at": 5, "faces_detected_at": None}
    (tmp_path / "one.json").write_text(json.dumps({"id": "one", "name": "n", "source_dir": "/x", "photos": [photo], "clusters": []}, indent=2))
    (tmp_path / "bad.json").write_text("{ not json")
    p, photos_, faces = projects.documents_as_tables(projects.read_documents(spark, str(tmp_path)))
    assert [r.project_id for r in p.collect()] == ["one"]
    assert photos_.first().sharpness_score == 12.5
    assert [r.cluster_id for r in faces.orderBy("face_ord").collect()] == [-1, 4, None]
    again = json.loads(projects.photo_documents(photos_, faces).first().document)
    assert again["faces"][1]["bbox"] == [1, 2, 3, 4] and again["faces"][2]["cluster_id"] is None


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert Config.load(path) == Config()
    Config(max_faces=7).save(path)
    assert Config.load(path).max_faces == 7
    (tmp_path / "c.json").write_text("[1]")
    assert Config.load(path) == Config()


def test_people_of_a_project(library, folder, spark):
    project = library.import_folder(str(folder))
    near = [1.0, 0.0], [0.99, 0.1], [0.0, 1.0]
    rows = [(project, r.path, r.photo_ord, 0, ((0.0, 0.0, 9.0, 9.0)), 0.5 + i / 10, near[i], None) for i, r in enumerate(library.photos(project).orderBy("photo_ord").limit(3).collect())]
    from photolake import schema as S

    library.store.write(spark.createDataFrame(rows, S.FACES), "faces", project)
    library.regroup(project)
    assert [r.cluster_id for r in library.faces(project).orderBy("photo_ord").collect()] == [0, 0, None]
    library.rename_person(project, 0, "Ada")
    people = library.clusters(project).collect()
    assert [(r.label, r.photo_count) for r in people] == [("Ada", 2)]
    assert library.view(project, 0).count() == 2 and library.view(project).count() == 4
    assert library.photos(project).where(F.col("faces_detected_at").isNotNull()).count() == 0


def test_names_stay_with_people_when_numbers_shift(spark, tmp_path, folder):
    """Earlier files of another person take the first number of a grouping, a late one joins two people."""
    from photolake import schema as S

    library = Library(spark, f"file://{tmp_path}/library")
    project = library.import_folder(str(folder))

    def face(path, i, *vector):
        return (project, path, None, i, (0.0, 0.0, 9.0, 9.0), 0.5, [float(x) for x in vector], None)

    paths = [r.path for r in library.photos(project).orderBy("photo_ord").collect()]
    ann, bob = (1, 0, 0), (0, 1, 0)

    def regrouped(rows):
        library.store.write(spark.createDataFrame(rows, S.FACES), "faces", project)
        library.regroup(project)
        people = {r.cluster_id: r.label for r in library.clusters(project).where("cluster_id >= 0").collect()}
        return {(r.path, r.face_ord): people.get(r.cluster_id) for r in library.faces(project).collect()}

    rows = [face(paths[2], 0, *ann), face(paths[3], 0, *ann)]
    regrouped(rows)
    library.rename_person(project, 0, "Ann")
    rows += [face(paths[0], 0, *bob), face(paths[1], 0, *bob)]
    now = regrouped(rows)
    assert now[paths[2], 0] == now[paths[3], 0] == "Ann"
    assert now[paths[0], 0] == now[paths[1], 0] == "Person 2"
    library.rename_person(project, 1, "Bob")
    # one face of each alone is noise; both are known again when they come back
    assert set(regrouped([rows[0], rows[2]]).values()) == {None}
    now = regrouped(rows)
    assert (now[paths[2], 0], now[paths[0], 0]) == ("Ann", "Bob")
    # a bridge joins them: the one with more faces stays, and the other is back after it is gone
    bridge = [face(paths[1], 1, 0.6, 0.6, 0), face(paths[2], 1, 1, 0.1, 0)]
    assert set(regrouped(rows + bridge).values()) == {"Ann"}
    now = regrouped(rows)
    assert (now[paths[2], 0], now[paths[0], 0]) == ("Ann", "Bob")


def test_polling_gives_up_after_some_failures(library, folder, monkeypatch):
    from pyspark.errors import AnalysisException

    project, looks = library.import_folder(str(folder)), []

    def broken(*_):
        looks.append(1)
        raise AnalysisException("a table is missing")

    monkeypatch.setattr(library, "photos", broken)
    with pytest.raises(AnalysisException):
        next(library.polled(project, 0, failures=3))
    assert len(looks) == 3


def test_photos_of_a_project_are_not_ordered_in_one_task(spark, tmp_path):
    library = Library(spark, str(tmp_path / "library"))
    rows = spark.createDataFrame([(f"/p/{i % 7}{i}.png", f"{i % 7}{i}.png") for i in range(50)], "path string, filename string")
    out = library._as_photos(rows, "p")
    assert [r.photo_ord for r in out.orderBy("filename", "path").collect()] == list(range(50))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "[project_id" not in "".join(line for line in plan.splitlines() if "Window" in line)
    assert "_range" in plan


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def part(field, data):
    """A field of a protocol buffer: a number, or bytes."""
    return varint(field << 3) + varint(data) if isinstance(data, int) else varint(field << 3 | 2) + varint(len(data)) + data


def tensor(name, *sides):
    shape = b"".join(part(1, part(1, n)) for n in sides)
    return part(1, name.encode()) + part(2, part(1, part(1, 1) + part(2, shape)))


def onnx_file(path, side):
    """A model file: the mean of each colour of a square picture of ``side``."""
    nodes = [part(1, b"x") + part(2, b"m") + part(4, b"GlobalAveragePool"), part(1, b"m") + part(2, b"y") + part(4, b"Flatten")]
    graph = b"".join(part(1, n) for n in nodes) + part(2, b"g") + part(11, tensor("x", 1, 3, side, side)) + part(12, tensor("y", 1, 3))
    path.write_bytes(part(1, 8) + part(7, graph) + part(8, part(1, b"") + part(2, 13)))
    return str(path)


def test_real_model_files_and_their_failures(spark, tmp_path):
    pixels = np.zeros((200, 200, 3), np.uint8) + np.array([40, 90, 200], np.uint8)
    image = spark.createDataFrame([("p", 200, 200, 3, bytearray(pixels.tobytes()))], "path string, width int, height int, channels int, pixels binary")
    points = [{"x": 20.0 + 2 * x, "y": 10.0 + 2 * y} for x, y in ((38, 52), (73, 52), (56, 72), (41, 92), (70, 92))]
    faces = spark.createDataFrame([("p", 0, points)], "path string, face_ord int, keypoints array<struct<x:double,y:double>>")
    good = models.embedded(image, faces, onnx_file(tmp_path / "good.onnx", 112)).collect()
    v = (np.array([200, 90, 40]) - 127.5) / 127.5
    assert good[0].error is None and np.allclose(good[0].embedding, v / np.sqrt((v * v).sum()), atol=1e-4)
    bad = models.embedded(image, faces, onnx_file(tmp_path / "bad.onnx", 64)).collect()
    assert bad[0].embedding is None and bad[0].error.startswith("Inference error: ")
    # a model with other outputs than a detector's, and one with another input
    for name, side in (("one", 640), ("two", 64)):
        raw = models.raw_detections(image, onnx_file(tmp_path / f"{name}.onnx", side)).collect()
        assert len(raw) == 1 and raw[0].error.startswith("Inference error: ")


def with_faces(library, spark, project, vectors):
    from photolake import schema as S

    rows = [(project, r.path, r.photo_ord, 0, (0.0, 0.0, 9.0, 9.0), 0.9, v, None) for r, v in zip(library.photos(project).orderBy("photo_ord").collect(), vectors)]
    library.store.write(spark.createDataFrame(rows, S.FACES), "faces", project)


def test_faces_follow_their_photos_when_an_earlier_file_appears(library, folder, spark):
    project = library.import_folder(str(folder))
    with_faces(library, spark, project, ([1.0, 0.0], [0.0, 1.0], [0.99, 0.1]))
    save(folder / "a0.png", np.full((30, 30, 3), 60))
    assert library.open_project(project) == 1
    library.regroup(project)
    found = {r.path.rsplit("/", 1)[1]: (r.photo_ord, r.cluster_id) for r in library.faces(project).collect()}
    assert found == {"a.png": (0, 0), "b.PNG": (2, None), "c.png": (3, 0)}
    assert library.faces(project).count() == 3
    assert library.has_clusters(project)


def test_the_trash_keeps_every_file(library, folder):
    project = library.import_folder(str(folder))
    trash = folder / "_trash"
    trash.mkdir()
    first = (folder / "c.png").read_bytes()
    (trash / "c.png").write_bytes(bytes(len(first)))
    plan = library.photos(project).where("filename = 'c.png'").withColumn("grade", F.lit("Bad"))
    from photolake.operators.export import trash_plan

    done = sinks.apply_plan(trash_plan(plan), move=True).collect()
    assert done[0].done and done[0].dest.endswith("/c 2.png")
    assert (trash / "c.png").read_bytes() == bytes(len(first)) and (trash / "c 2.png").read_bytes() == first
    assert not (folder / "c.png").exists()


def test_a_stale_copy_of_equal_size_is_replaced(spark, tmp_path):
    (tmp_path / "new.tif").write_bytes(b"new content")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "new.tif").write_bytes(b"old content")
    plan = spark.createDataFrame([(f"file:{tmp_path}/new.tif", f"file:{tmp_path}/out/new.tif"), (f"file:{tmp_path}/none.tif", f"file:{tmp_path}/out/none.tif")], "path string, dest string")
    done = {r.path.rsplit("/", 1)[1]: r for r in sinks.apply_plan(plan).collect()}
    assert done["new.tif"].done and (tmp_path / "out" / "new.tif").read_bytes() == b"new content"
    assert not done["none.tif"].done and done["none.tif"].error.startswith("IO error: ")
    assert (tmp_path / "new.tif").exists() and [p.name for p in (tmp_path / "out").iterdir() if "part" in p.name] == []


def test_graded_photos_are_told_one_by_one_and_kept_part_by_part(spark, tmp_path, folder):
    library = Library(spark, f"file://{tmp_path}/library", Config(part_photos=1))
    project = library.import_folder(str(folder))
    told, graded = [], []

    def report(stage, rows):
        told.append(stage)
        if stage == "photo_graded":
            assert rows.count() > 0
            graded.extend((r.path.rsplit("/", 1)[1], r.grade, r.grade_source) for r in rows.collect())
            if told.count("photo_graded") == 1:
                raise RuntimeError("the run breaks off")

    with pytest.raises(RuntimeError):
        library.start_enrichment(project, report, now=5)
    # the part that was told about is there, and so is the end of the run that broke off
    assert told[-1] == "complete" and len(graded) == 1
    library.start_enrichment(project, report, now=6)
    assert sorted(name for name, _, _ in graded) == ["a.png", "b.PNG", "c.png"]
    times = {r.filename: r.graded_at for r in library.photos(project).collect()}
    assert 5 in times.values() and set(times.values()) <= {5, 6}


def test_thumbnails_serve_for_grading_and_a_run_in_the_background_ends(library, folder):
    project = library.import_folder(str(folder))
    told = []
    done = library.enrich_in_background(project, lambda stage, rows: told.append((stage, rows.first())), now=9)
    looks = list(library.polled(project, 0.5)) if library.check_models() else []
    assert looks == [] and done.result(120).first().to_grade == 0
    assert [s for s, _ in told][0] == "thumbnails" and told[-1][0] == "complete"
    assert ("thumbnails", (4, 4)) in [(s, tuple(r)) for s, r in told if s == "thumbnails"]
    assert grades(library, project)["c.png"][2].endswith("Overexposed")
    picture = np.arange(2700, dtype=np.uint8).reshape(30, 30, 3)
    assert (sinks.opened_png(sinks.png(picture)) == picture).all()


def test_polling_shows_changes_and_stops_by_itself(library, folder, spark):
    project = library.import_folder(str(folder))
    looks = library.polled(project, 0)
    assert next(looks).count() == 4
    path = library.photos(project).where("filename = 'b.PNG'").first().path
    library.update_grade(project, path, "Good")
    assert [r.path for r in next(looks).collect()] == [path]
    stored = library._stored(project).withColumn("graded_at", F.lit(1).cast("long")).withColumn("faces_detected_at", F.lit(2).cast("long"))
    library._save_photos(stored, project)
    assert next(looks).count() == 4
    assert next(looks, None) is None


def test_folders_that_are_not_there(library, folder, tmp_path):
    with pytest.raises(NotFound, match="Not found: "):
        library.import_folder(str(tmp_path / "nowhere"))
    project = library.import_folder(str(folder))
    folder.rename(tmp_path / "elsewhere")
    assert library.open_project(project) == 0 and library.photos(project).count() == 4
    assert not library.has_clusters(project) and library.can_export(project) and not library.can_export(project, "GoodOnly")


def test_lines_of_a_project_can_be_read_back(library, folder, spark):
    project = library.import_folder(str(folder))
    with_faces(library, spark, project, ([1.0, 0.0], [0.0, 1.0]))
    lines = projects.photo_documents(library.photos(project), library.faces(project))
    photos_, faces = projects.photo_documents_as_tables(lines)
    assert sorted(r.path for r in photos_.collect()) == sorted(r.path for r in library.photos(project).collect())
    assert [(r.face_ord, r.bbox.x2, r.embedding) for r in faces.orderBy("photo_ord").collect()] == [(0, 9.0, [1.0, 0.0]), (0, 9.0, [0.0, 1.0])]


def test_settings_in_sections(tmp_path):
    import json

    nested = {"detection": {"min_confidence": 0.6, "min_face_size": 40, "nms_threshold": 0.3, "input_size": [320, 320]}, "clustering": {"eps": 0.5, "min_samples": 4}, "grading": {"sharpness_threshold": 50, "exposure_clip_threshold": 0.2, "aesthetic_good_threshold": 4.5}, "thumbnails": {"max_size": 200}}
    (tmp_path / "c.json").write_text(json.dumps(nested))
    found = Config.load(str(tmp_path / "c.json"))
    assert (found.detector_size, found.cluster_min_samples, found.sharpness_threshold, found.thumbnail_side, found.max_faces) == (320, 4, 50.0, 200, 30)
    del nested["clustering"]["eps"]
    (tmp_path / "c.json").write_text(json.dumps(nested))
    assert Config.load(str(tmp_path / "c.json")) == Config()


def test_sizes_of_pictures():
    from photolake.functions.images import lanczos, smooth

    flat = np.full((40, 60, 3), 77, np.uint8)
    assert (smooth(flat, 7, 11) == 77).all() and (lanczos(flat, 7, 11) == 77).all() and lanczos(flat, 80, 90).shape == (80, 90, 3)
    ramp = np.repeat(np.arange(64, dtype=np.uint8)[None, :, None] * 4, 3, 2).repeat(64, 0)
    assert np.abs(lanczos(ramp, 32, 32)[16, 4:28, 0].astype(int) - (np.arange(4, 28) * 8 + 2)).max() <= 1
