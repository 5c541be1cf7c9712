"""A folder of pictures as a source of rows, for tables and for streams.

Unlike Spark's own readers it sees names that begin with a dot or an underscore and empty files, reads no
more of a file than the prefix that is hashed, and does not go below the folder. It reads whatever file
system Arrow knows, which must be the same for the driver and all executors.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from photolake.config import IMAGE_EXTENSIONS, Config

FORMAT = "photo_folder"
SCHEMA = "path string, filename string, bytes long, modified timestamp, content_hash string"


@dataclass
class Files(InputPartition):
    """Some files of a folder: ``path, bytes, modified`` in nanoseconds."""

    uri: str
    files: list[tuple[str, int, int]]


def _opened(uri: str) -> tuple:
    """The file system of a URI, its path in there, and what stands before paths in the names that Spark gives."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        # as Spark takes them, letter for letter
        path = "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else posixpath.abspath(uri)
        return fs.LocalFileSystem(), path.rstrip("/") or "/", "file:"
    system, path = fs.FileSystem.from_uri(uri)
    scheme, _, rest = uri.partition("://")
    return system, path.rstrip("/"), f"{scheme}://{rest.split('/')[0]}" if scheme in ("hdfs", "viewfs") else f"{scheme}://"


def listed(uri: str, extensions: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """``path, bytes, modified`` of the images that lie in a folder itself, by name."""
    from pyarrow import fs

    system, path, _ = _opened(uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=True))
    kept = [f for f in found if f.type == fs.FileType.File and f.extension.lower() in extensions]
    return sorted((f.path, f.size or 0, f.mtime_ns or 0) for f in kept)


def dealt(uri: str, files: list[tuple[str, int, int]], each: int) -> list[Files]:
    """The files in parts of ``each``; one part without files where there are none."""
    return [Files(uri, files[i : i + each]) for i in range(0, len(files), each)] or [Files(uri, [])]


def rows_of(part: Files, prefix: int) -> Iterator[tuple]:
    """:data:`SCHEMA` of the files of a part; one that is gone or cannot be read has no hash."""
    system, _, before = _opened(part.uri)
    for path, size, modified in part.files:
        try:
            with system.open_input_stream(path) as f:
                digest = hashlib.sha256(f.read(prefix)).hexdigest()
        except OSError:
            digest = None
        yield before + path, posixpath.basename(path), size, datetime.fromtimestamp(modified / 1e9, UTC), digest


class FolderSource(DataSource):
    """``spark.read.format("photo_folder")`` and ``readStream``; options as in :func:`scan` and :func:`stream`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(self.options)


class _Settings:
    def __init__(self, options) -> None:
        self.uri = options["path"]
        self.extensions = tuple(options.get("extensions", ",".join(IMAGE_EXTENSIONS)).split(","))
        self.prefix, self.each = int(options.get("prefix", 65_536)), int(options.get("filesEach", 256))

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(partition, self.prefix)


class FolderReader(_Settings, DataSourceReader):
    """The folder as it is when the query is planned; each task reads some of its files."""

    def partitions(self) -> list[Files]:
        return dealt(self.uri, listed(self.uri, self.extensions), self.each)


class FolderStream(_Settings, DataSourceStreamReader):
    """New files of the folder, each once.

    What each batch takes is written to ``log`` before it is read: entry n holds the files of batch n,
    and an offset is a number of entries. So a batch that is run again reads the same files, whatever
    has come in since, and after a restart only files that no entry holds are new. An entry appears at
    once, by being renamed.
    """

    def __init__(self, options) -> None:
        super().__init__(options)
        self.log, self.most = options["log"], int(options.get("filesPerBatch", 1000))
        self.age = float(options.get("secondsOld", 0))
        self.seen: set[str] = set()
        self.entries = 0
        system, path, _ = _opened(self.log)
        system.create_dir(path)
        while (entry := self._entry(self.entries)) is not None:
            self.seen |= {f[0] for f in entry}
            self.entries += 1

    def _entry(self, n: int) -> list | None:
        system, path, _ = _opened(self.log)
        try:
            with system.open_input_stream(f"{path}/{n}.json") as f:
                return [tuple(x) for x in json.loads(f.read())]
        except FileNotFoundError:
            return None

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        until = (time.time() - self.age) * 1e9
        new = [f for f in listed(self.uri, self.extensions) if f[0] not in self.seen and (not self.age or f[2] <= until)][: self.most]
        if new:
            system, path, _ = _opened(self.log)
            draft = f"{path}/.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as f:
                f.write(json.dumps(new).encode())
            system.move(draft, f"{path}/{self.entries}.json")
            self.seen |= {f[0] for f in new}
            self.entries += 1
        return {"entries": self.entries}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        files = [f for n in range(start["entries"], end["entries"]) for f in self._entry(n) or []]
        return dealt(self.uri, files, self.each)


def scan(spark: SparkSession, folder: str, config: Config = Config(), files_each: int = 256) -> DataFrame:
    """:data:`SCHEMA` of the images in a folder now; tasks read ``files_each`` files each."""
    spark.dataSource.register(FolderSource)
    return spark.read.format(FORMAT).option("prefix", config.hash_prefix_bytes).option("filesEach", files_each).load(folder)


def stream(spark: SparkSession, folder: str, log: str, config: Config = Config(), seconds_old: float = 0) -> DataFrame:
    """:data:`SCHEMA` of files as they appear, ``config.batch_photos`` at a time.

    ``log`` is a folder of this stream alone, kept as long as its checkpoint. Files that were changed
    within the last ``seconds_old`` seconds wait, as they may be on their way still.
    """
    spark.dataSource.register(FolderSource)
    reader = spark.readStream.format(FORMAT).option("prefix", config.hash_prefix_bytes).option("log", log)
    return reader.option("filesPerBatch", config.batch_photos).option("secondsOld", seconds_old).load(folder)
