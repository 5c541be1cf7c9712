"""Kinds of failures that a user of the library meets; their text begins as the kind does."""

from __future__ import annotations


# How the texts of failures begin.
class Failure(Exception):
    prefix = ""

    def __str__(self) -> str:
        return f"{self.prefix}{super().__str__()}"


class StorageFailure(Failure, OSError):
    """A file or folder could not be read, written or moved."""

    prefix = "IO error: "


class ImageFailure(Failure):
    prefix = "Image error: "


class DocumentFailure(Failure, ValueError):
    """A JSON document is not what it should be."""

    prefix = "JSON error: "


class ModelNotFound(Failure, LookupError):
    prefix = "Model not found: "


class InferenceFailure(Failure):
    prefix = "Inference error: "


class NotFound(Failure, LookupError):
    """No project, folder, photo or copy bears the name that was asked for."""

    prefix = "Not found: "


class OtherFailure(Failure):
    pass


def told(kind: type[Failure], cause: object) -> str:
    """The text of a failure as it stands in an ``error`` column."""
    return str(kind(cause))
