"""Names, paths and counts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photolake.config import IMAGE_EXTENSIONS


def extension(path: Column) -> Column:
    """Lower-case letters behind the last dot of the file name; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def content_hash(content: Column, prefix: int) -> Column:
    """SHA-256 of the first ``prefix`` bytes."""
    return F.sha2(F.substring(content.cast("binary"), 1, prefix), 256)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, part * 100.0 / total).otherwise(F.lit(0.0))


def initial(label: Column) -> Column:
    return F.upper(F.substring(label, 1, 1))


def stage(name: Column) -> Column:
    """Download and extract steps are one stage."""
    return F.when(name.startswith("Download") | name.startswith("Extract"), F.lit("downloading")).otherwise(name)


def destination(folder: str, filename: Column, label: Column | None = None) -> Column:
    return F.concat_ws("/", F.lit(folder.rstrip("/")), *([label] if label is not None else []), filename)
