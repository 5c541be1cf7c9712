"""Image folders as tables: names, content hashes and decoded pixels."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.config import Config
from photolake.functions import exif
from photolake.functions.text import basename, content_hash, is_image
from photolake.sources import folder as source


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """``path, filename, bytes, modified`` of the images in a folder, not in folders below it.

    File contents are not read. Spark skips names that begin with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    return files.where(is_image(F.col("path"))).select("path", basename(F.col("path")).alias("filename"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def scanned(spark: SparkSession, folder: str, config: Config = Config()) -> DataFrame:
    """``path, filename, content_hash`` of the images in a folder; the hash covers a prefix of the file.

    Local and shared folders are read by :mod:`photolake.sources.folder`, which sees every file; stores
    that only Spark knows by its own reader, which passes over empty files and names that begin with a
    dot or an underscore.
    """
    if folder.startswith("file:") or "://" not in folder:
        return source.scan(spark, folder, config).select("path", "filename", "content_hash")
    files = spark.read.format("binaryFile").load(folder).where(is_image(F.col("path")))
    return files.select("path", basename(F.col("path")).alias("filename"), content_hash(F.col("content"), config.hash_prefix_bytes).alias("content_hash"))


def headers(spark: SparkSession, files: list[str], config: Config = Config()) -> DataFrame:
    """``path`` and what stands in the headers of these files (:data:`photolake.functions.exif.HEADER`)."""
    found = spark.read.format("binaryFile").load([_plain(p) for p in files])
    return exif.headers(found.select("path", "content"), "path", F.col("content"), config.header_prefix_bytes)


def _plain(path: str) -> str:
    """A path whose letters stand for themselves where patterns are read."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def decoded(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """``path, width, height, channels, pixels`` with the bytes of each row in BGR order.

    Paths are written as the other readers do, with one slash behind the scheme of local files.
    Files that cannot be decoded have a width and height of -1. ``folder`` may be a list of files, of
    which only these are read.
    """
    images = spark.read.format("image").load(folder if isinstance(folder, str) else [_plain(p) for p in folder])
    found = images.select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))
    return found.where(is_image(F.col("path")))
