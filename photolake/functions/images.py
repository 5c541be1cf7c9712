"""Measures and sizes of decoded pictures: numpy on the pixels of one row inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.config import Config
from photolake.errors import ImageFailure, told

MEASURES = "path string, sharpness double, bright double, dark double, contrast double, saturation double, error string"


def rgb_of(pixels: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Red, green and blue of every pixel from BGR, BGRA or gray bytes."""
    a = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    return a[:, :, [2, 1, 0]] if channels >= 3 else np.repeat(a[:, :, :1], 3, 2)


def gray_of(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.int64) @ np.array([2126, 7152, 722]) // 10000


def upright(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """Pixels turned and mirrored as the orientation (1 to 8) of a picture's header asks for."""
    if orientation in (5, 6, 7, 8):
        pixels = np.swapaxes(pixels, 0, 1)
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels


def turned(images: DataFrame) -> DataFrame:
    """Decoded pictures with an ``orientation``, upright; those that could not be decoded stay as they are."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                width, height, pixels = row["width"], row["height"], row["pixels"]
                if width > 0 and len(pixels) == width * height * row["channels"]:
                    shown = upright(np.frombuffer(pixels, np.uint8).reshape(height, width, -1), row["orientation"])
                    height, width, pixels = *shown.shape[:2], np.ascontiguousarray(shown).tobytes()
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "width": width, "height": height, "channels": row["channels"], "pixels": pixels}], kinds)

    kinds = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixels", pa.binary())])
    return images.select("path", "width", "height", "channels", "pixels", "orientation").mapInArrow(turn, "path string, width int, height int, channels int, pixels binary")


def nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image with each new pixel taken from the old one at its centre."""
    rows = np.minimum((np.arange(height) + 0.5) * image.shape[0] / height, image.shape[0] - 1).astype(int)
    columns = np.minimum((np.arange(width) + 0.5) * image.shape[1] / width, image.shape[1] - 1).astype(int)
    return image[rows][:, columns]


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def lanczos3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


def _along(image: np.ndarray, new: int, weight, reach: int) -> np.ndarray:
    """The rows of an image at another number: each new one a weighted sum of the old ones within reach."""
    old = len(image)
    scale = max(old / new, 1.0)
    centre = (np.arange(new)[:, None] + 0.5) * old / new
    at = np.floor(centre - reach * scale).astype(np.int64) + np.arange(int(np.ceil(2 * reach * scale)) + 2)
    w = weight((at + 0.5 - centre) / scale) * ((at >= 0) & (at < old))
    w /= w.sum(1, keepdims=True)
    out, at = np.zeros((new, *image.shape[1:])), np.clip(at, 0, old - 1)
    for t in np.flatnonzero(w.any(0)):
        out += w[:, t].reshape(-1, *[1] * (image.ndim - 1)) * image[at[:, t]]
    return out


def resized(image: np.ndarray, height: int, width: int, weight, reach: int) -> np.ndarray:
    if image.shape[:2] == (height, width):
        return image  # both kinds of weights are 1 at the pixel itself and 0 at all others
    tall = _along(image.astype(np.float64), height, weight, reach)
    wide = np.moveaxis(_along(np.moveaxis(tall, 1, 0), width, weight, reach), 0, 1)
    return np.clip(np.rint(wide), 0, 255).astype(np.uint8)


def smooth(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size by triangle weights along both sides."""
    return resized(image, height, width, triangle, 1)


def lanczos(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size by windowed sines of three lobes along both sides."""
    return resized(image, height, width, lanczos3, 3)


def fitted(width: int, height: int, side: int) -> tuple[int, int]:
    """Width and height within a square, never larger than they were."""
    scale = min(1.0, side / max(width, height))
    return max(1, round(width * scale)), max(1, round(height * scale))


def measure(rgb: np.ndarray, sharp_side: int) -> tuple[float, float, float, float, float]:
    """Sharpness, shares of bright and dark pixels, contrast, saturation."""
    gray = gray_of(rgb)
    height, width = gray.shape
    longest = max(height, width)
    g = nearest(gray, max(round(height * sharp_side / longest), 3), max(round(width * sharp_side / longest), 3)).astype(np.float64)
    edges = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    high, low = rgb.max(2).astype(np.float64), rgb.min(2)
    colour = np.where(high > 0, (high - low) / np.maximum(high, 1), 0)
    return float(edges.var()), float((gray >= 246).mean()), float((gray < 10).mean()), float(min(gray.std() / 128, 1.0)), float(colour.mean())


def measured(images: DataFrame, config: Config = Config()) -> DataFrame:
    """:data:`MEASURES` of decoded pictures, in one narrow pass; thresholds are left to columns.

    A picture that could not be decoded has no measures and the reason in ``error``.
    """
    side, box = config.sharpness_side, config.grading_side

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    rgb = rgb_of(row["pixels"], row["width"], row["height"], row["channels"])
                    wide, high = fitted(row["width"], row["height"], box)
                    if (high, wide) != rgb.shape[:2]:
                        rgb = smooth(rgb, high, wide)
                    out.append((row["path"], *measure(rgb, side), None))
                except (ValueError, TypeError, IndexError) as x:
                    out.append((row["path"], None, None, None, None, None, told(ImageFailure, x)))
            types = [pa.string(), *[pa.float64()] * 5, pa.string()]
            names = [c.split()[0] for c in MEASURES.split(", ")]
            columns = list(zip(*out)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return images.select("path", "width", "height", "channels", "pixels").where(F.col("path").isNotNull()).mapInArrow(rate, MEASURES)
