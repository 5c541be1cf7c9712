import hashlib
import os

import pytest

from photolake.config import Config
from photolake.sources import folder as source


def put(place, name, data=b"data"):
    (place / name).write_bytes(data)


@pytest.fixture
def place(tmp_path):
    p = tmp_path / "in [1]"
    p.mkdir()
    for name in ("b.JPG", ".hidden.png", "_x.tif", "c d.heic", "é.jpeg"):
        put(p, name, name.encode())
    put(p, "empty.png", b"")
    put(p, "notes.txt")
    put(p, "long.jpg", b"x" * 100_000)
    (p / "below.png").mkdir()
    put(p / "below.png", "e.png")
    return p


@pytest.mark.parametrize("form", ["{}", "file://{}", "file:{}"])
def test_all_images_of_the_folder_itself(spark, place, form):
    found = {r.filename: r for r in source.scan(spark, form.format(place), files_each=2).collect()}
    assert sorted(found) == sorted(["b.JPG", ".hidden.png", "_x.tif", "c d.heic", "é.jpeg", "empty.png", "long.jpg"])
    assert found["empty.png"].bytes == 0 and found["empty.png"].content_hash == hashlib.sha256(b"").hexdigest()
    assert found["long.jpg"].content_hash == hashlib.sha256(b"x" * 65_536).hexdigest()
    assert found["b.JPG"].path == f"file:{place}/b.JPG"


def test_parts_are_planned(spark, place):
    assert source.scan(spark, str(place), files_each=2).rdd.getNumPartitions() == 4


def test_a_file_that_goes_before_it_is_read_has_no_hash(place):
    parts = source.dealt(str(place), source.listed(str(place), ("jpg",)), 10)
    os.remove(place / "b.JPG")
    assert {r[1]: r[4] is None for p in parts for r in source.rows_of(p, 10)} == {"b.JPG": True, "long.jpg": False}


def test_a_folder_without_pictures_and_one_that_is_not_there(spark, tmp_path):
    assert source.scan(spark, str(tmp_path)).count() == 0
    assert source.scan(spark, str(tmp_path / "none")).count() == 0


def test_a_stream_gives_each_file_once_over_restarts_and_failures(spark, place, tmp_path):
    taken, broken = [], []

    def write(batch, number):
        rows = sorted(r.filename for r in batch.collect())
        if number == 1 and not broken:
            broken.append(rows)
            # files that come in meanwhile are not mixed into the batch when it is run again
            put(place, "a_new.png")
            raise RuntimeError("the batch breaks off")
        taken.append(rows)

    def run():
        stream = source.stream(spark, str(place), str(tmp_path / "log"), Config(batch_photos=3))
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception):
        run()
    run()
    assert taken[1] == broken[0]
    assert sorted(x for rows in taken for x in rows) == sorted([".hidden.png", "_x.tif", "a_new.png", "b.JPG", "c d.heic", "empty.png", "long.jpg", "é.jpeg"])
    assert max(map(len, taken)) <= 3
    put(place, "late.png")
    run()
    assert taken[-1] == ["late.png"] and sum(map(len, taken)) == 9


def test_young_files_wait(place, tmp_path):
    os.utime(place / "b.JPG", (1, 1))
    options = {"path": str(place), "log": str(tmp_path / "log"), "secondsOld": "3600"}
    reader = source.FolderStream(options)
    assert reader.latestOffset() == {"entries": 1}
    assert [f[0].rsplit("/", 1)[1] for p in reader.partitions({"entries": 0}, {"entries": 1}) for f in p.files] == ["b.JPG"]
    assert source.FolderStream(options).latestOffset() == {"entries": 1}
