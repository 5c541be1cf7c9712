"""Where results go: small copies of pictures, copied and discarded files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.config import Config
from photolake.errors import ImageFailure, StorageFailure, told
from photolake.functions.images import fitted, lanczos, rgb_of, smooth

COPIES = "path string, content_hash string, kind string, width int, height int, png binary, error string"
APPLIED = "path string, dest string, done boolean, error string"


def png(rgb: np.ndarray) -> bytes:
    """The picture as a PNG file."""
    lines = np.zeros((rgb.shape[0], rgb.shape[1] * 3 + 1), np.uint8)
    lines[:, 1:] = rgb.reshape(rgb.shape[0], -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def opened_png(data: bytes) -> np.ndarray:
    """The picture in a file that :func:`png` made."""
    width, height = struct.unpack(">II", data[16:24])
    at, lines = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            lines += data[at + 8 : at + 8 + size]
        at += size + 12
    return np.frombuffer(zlib.decompress(lines), np.uint8).reshape(height, width * 3 + 1)[:, 1:].reshape(height, width, 3)


def opened(copies: DataFrame) -> DataFrame:
    """``path, width, height, channels, pixels`` of small copies, as readers of pictures give them."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rgb = opened_png(data)
                    out.append((path, rgb.shape[1], rgb.shape[0], 3, rgb[:, :, ::-1].tobytes()))
                except (ValueError, TypeError, struct.error, zlib.error):
                    out.append((path, -1, -1, -1, b""))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["path", "width", "height", "channels", "pixels"])

    return copies.select("path", "png").mapInArrow(look, "path string, width int, height int, channels int, pixels binary")


def small_copies(images: DataFrame, config: Config = Config()) -> DataFrame:
    """:data:`COPIES`: each picture, decoded once, as a thumbnail and as a working copy.

    ``images`` bears ``content_hash``, by which copies are known, so a changed file gets new ones.
    """
    sides = (("thumbnail", config.thumbnail_side, lanczos), ("working", config.working_side, smooth))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for kind, side, resized in sides:
                    try:
                        rgb = rgb_of(row["pixels"], row["width"], row["height"], row["channels"])
                        width, height = fitted(row["width"], row["height"], side)
                        out.append((row["path"], row["content_hash"], kind, width, height, png(resized(rgb, height, width)), None))
                    except (ValueError, TypeError, IndexError) as x:
                        out.append((row["path"], row["content_hash"], kind, None, None, None, told(ImageFailure, x)))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [c.split()[0] for c in COPIES.split(", ")])

    return images.select("path", "content_hash", "width", "height", "channels", "pixels").mapInArrow(copy, COPIES)


def without_copies(photos: DataFrame, copies: DataFrame) -> DataFrame:
    """Photos whose content has no working copy yet."""
    done = copies.where("error is null").select("path", "content_hash").distinct()
    return photos.join(done, ["path", "content_hash"], "left_anti")


def apply_plan(plan: DataFrame, move: bool = False) -> DataFrame:
    """Copy, or move, the files of ``path, dest``; :data:`APPLIED` tells what came of each.

    A file is written under another name, one for each attempt, and then put in its place. A file that
    is there already counts as done only if its contents are the same, so a task that is run again
    changes nothing. Otherwise a copy replaces it, and a move takes the next free name (``a 2.jpg``),
    which ``dest`` tells. Nothing is deleted but a source whose contents stand at its destination.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()

        def place(uri: str):
            return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))

        def alike(source, a: str, target, b: str) -> bool:
            if source.get_file_info(a).size != target.get_file_info(b).size:
                return False
            with source.open_input_stream(a) as x, target.open_input_stream(b) as y:
                while (one := x.read(1 << 20)) == y.read(1 << 20):
                    if not one:
                        return True
            return False

        def free(source, a: str, target, b: str) -> tuple[str, bool]:
            """The first name at ``b`` that no other file has, and whether the file stands there already."""
            head, dot, tail = b.rpartition(".") if "." in b.rsplit("/", 1)[1] else (b, "", "")
            k, name = 1, b
            while target.get_file_info(name).type != fs.FileType.NotFound:
                if alike(source, a, target, name):
                    return name, True
                k += 1
                name = f"{head} {k}{dot}{tail}"
            return name, False

        for batch in batches:
            out = []
            for path, dest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    (source, a), (target, b) = place(path), place(dest)
                    made = target.get_file_info(b).type == fs.FileType.File
                    if move and made and source.get_file_info(a).type == fs.FileType.NotFound:
                        # an earlier attempt has moved it
                        out.append((path, dest, True, None))
                        continue
                    if move:
                        name, done = free(source, a, target, b)
                        dest, b = dest[: len(dest) - len(b.rsplit("/", 1)[1])] + name.rsplit("/", 1)[1], name
                    else:
                        done = made and alike(source, a, target, b)
                    if not done:
                        target.create_dir(b.rsplit("/", 1)[0], recursive=True)
                        fs.copy_files(a, f"{b}.{attempt}.part", source_filesystem=source, destination_filesystem=target)
                        target.move(f"{b}.{attempt}.part", b)
                    if move:
                        source.delete_file(a)
                    out.append((path, dest, True, None))
                except (OSError, ValueError) as x:
                    out.append((path, dest, False, told(StorageFailure, x)))
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.string()]
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["path", "dest", "done", "error"])

    return plan.select(F.col("path"), F.col("dest")).mapInArrow(run, APPLIED)
