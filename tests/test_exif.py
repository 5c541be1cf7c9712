import random
import struct

import numpy as np
import pytest

from photolake.api import Library
from photolake.config import Config
from photolake.functions import exif, images


def tiff(entries, more=(), order="<"):
    """A TIFF structure of ``tag, type, values``; ``more`` are those of the second directory."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8))

    def directory(some, at):
        end = at + 2 + 12 * len(some) + 4
        body, behind = struct.pack(order + "H", len(some)), b""
        for tag, kind, value in some:
            if kind == 2:
                raw = value.encode() + b"\0"
                count = len(raw)
            elif kind == 5:
                raw, count = struct.pack(order + "II", *value), 1
            else:
                raw, count = struct.pack(order + exif.NUMBERS[kind], value), 1
            if len(raw) > 4:
                place, behind = struct.pack(order + "I", end + len(behind)), behind + raw
            else:
                place = raw.ljust(4, b"\0")
            body += struct.pack(order + "HHI", tag, kind, count) + place
        return body + b"\0" * 4 + behind

    if more:
        size = len(directory([*entries, (exif.MORE, 4, 0)], 8))
        entries = [*entries, (exif.MORE, 4, 8 + size)]
    out += directory(entries, 8)
    if more:
        out += directory(more, len(out))
    return bytes(out)


def jpeg(block):
    body = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\x02pixels"


FULL = ([(exif.ORIENTATION, 3, 6), (exif.MAKE, 2, "Maker"), (exif.DATE, 2, "2020:01:02 03:04:05")], [(exif.TAKEN, 2, "2019:12:31 23:59:58"), (exif.PARTS_OF_SECOND, 2, "25"), (exif.EXPOSURE, 5, (1, 200)), (exif.APERTURE, 5, (28, 10)), (exif.ISO, 3, 400), (exif.FOCAL_LENGTH, 5, (0, 0))])


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("around", [jpeg, lambda x: x, lambda x: b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 2) + b"IHDRxxCRCC" + struct.pack(">I", len(x)) + b"eXIf" + x])
def test_headers_in_both_orders_of_bytes(order, around):
    found = exif.header(around(tiff(*FULL, order=order)))
    assert found == ("2019-12-31 23:59:58.25", 6, "Maker", None, 0.005, 2.8, 400, None)


def test_broken_headers_are_borne_with():
    good = jpeg(tiff(*FULL))
    rng = random.Random(1)
    for k in range(len(good)):
        exif.header(good[:k])
    for _ in range(2000):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        assert len(exif.header(bytes(bad))) == 8
    none = (None,) * 8
    assert exif.header(None) == exif.header(b"") == exif.header(b"\xff\xd8\xff") == exif.header(b"text") == none
    # a directory that points to itself, times and orientations that are none
    assert exif.header(tiff([(exif.MORE, 4, 8), (exif.ORIENTATION, 3, 9), (exif.DATE, 2, "0000:00:00 00:00:00")])) == none
    assert exif.header(tiff([(exif.DATE, 2, "2020:02:30 00:00:00"), (exif.ISO, 2, "x")])) == none


def test_pictures_are_turned_as_their_orientation_asks():
    shown = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    stored = {1: shown, 2: shown[:, ::-1], 3: shown[::-1, ::-1], 4: shown[::-1], 5: shown.swapaxes(0, 1), 6: np.rot90(shown, 1), 7: shown[::-1, ::-1].swapaxes(0, 1), 8: np.rot90(shown, -1)}
    for orientation, pixels in stored.items():
        assert (images.upright(pixels, orientation) == shown).all(), orientation
    assert (images.upright(shown, None) == shown).all()


def test_a_folder_in_the_order_of_time_with_upright_copies(spark, tmp_path):
    folder = tmp_path / "wedding"
    folder.mkdir()
    picture = spark._jvm.java.awt.image.BufferedImage(60, 40, 1)
    raw = tmp_path / "raw.jpg"
    spark._jvm.javax.imageio.ImageIO.write(picture, "jpg", spark._jvm.java.io.File(str(raw)))
    data = raw.read_bytes()

    def with_header(block):
        body = b"Exif\0\0" + block
        return data[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + data[2:]

    (folder / "a.jpg").write_bytes(with_header(tiff([(exif.DATE, 2, "2021:05:05 10:00:00"), (exif.ORIENTATION, 3, 1)])))
    (folder / "b.jpg").write_bytes(with_header(tiff([(exif.DATE, 2, "2021:05:05 09:00:00"), (exif.ORIENTATION, 3, 6)], order=">")))
    (folder / "c.jpg").write_bytes(data)
    (folder / "d.jpg").write_bytes(with_header(b"II*\0\xff\xff"))
    library = Library(spark, f"file://{tmp_path}/library", Config(part_photos=2))
    project = library.import_folder(str(folder))
    found = library.by_time(project).orderBy("place").collect()
    assert [r.filename for r in found] == ["b.jpg", "a.jpg", "c.jpg", "d.jpg"]
    assert str(found[0].taken) == "2021-05-05 09:00:00" and found[2].taken is found[3].taken is None
    assert [r.orientation for r in found] == [6, 1, None, None]
    assert library.generate_thumbnails(project) == 4
    from photolake.sources import sinks

    sides = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in library.store.read_all("copies", sinks.COPIES, project).where("kind = 'working'").collect()}
    assert sides == {"a.jpg": (60, 40), "b.jpg": (40, 60), "c.jpg": (60, 40), "d.jpg": (60, 40)}
    # a file that changes is read again
    (folder / "a.jpg").write_bytes(with_header(tiff([(exif.DATE, 2, "2021:05:05 08:00:00")])))
    library.open_project(project)
    assert [r.filename for r in library.by_time(project).orderBy("place").collect()][0] == "a.jpg"
    assert library.headers(project).count() == 4


def test_headers_of_the_query_are_read_once(spark, sf_dir, monkeypatch):
    from photolake.plans import activity

    read, real = spark.sparkContext.accumulator(0), activity.exif.headers

    def counted(*args):
        found = real(*args)

        def count(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return found.mapInArrow(count, found.schema)

    monkeypatch.setattr(activity.exif, "headers", counted)
    assert activity.header_times(spark, sf_dir).count() == read.value


def test_times_as_cameras_spell_them():
    from photolake.functions.exif import _time

    assert _time("2024:1:5 3:4:5", None) == "2024-01-05 03:04:05"
    assert _time("0999:01:01 00:00:00", "12") == "0999-01-01 00:00:00.12"
    assert [_time(x, None) for x in ("2024:02:30 00:00:00", "2024:01:01 24:00:00", "2024:01:01 23:59:60", "0000:00:00 00:00:00", "", None)] == [None] * 6
