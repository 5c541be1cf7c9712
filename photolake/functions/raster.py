"""Image measures over pixel arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mean(x: Column) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return total / F.nullif(F.size(x).cast("double"), F.lit(0.0))


def laplacian_variance(gray: Column, width: Column, height: Column) -> Column:
    """Population variance of the 4-neighbour Laplacian over interior pixels; 0 if there are none."""
    at = lambda x, y: F.get(gray, (y * width + x).cast("int")).cast("double")
    inner = F.flatten(F.transform(F.sequence(F.lit(1), height - 2), lambda y: F.transform(F.sequence(F.lit(1), width - 2), lambda x: at(x, y - 1) + at(x, y + 1) + at(x - 1, y) + at(x + 1, y) - 4 * at(x, y))))
    sums = F.aggregate(inner, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")))
    n = ((width - 2) * (height - 2)).cast("double")
    return F.when((width < 3) | (height < 3), F.lit(0.0)).otherwise(sums["q"] / n - (sums["s"] / n) * (sums["s"] / n))


def exposure(gray: Column, clip: float) -> tuple[Column, Column]:
    """Whether more than ``clip`` of the pixels are over 245, and under 10; false without pixels."""
    share = lambda hit: F.coalesce(_mean(F.transform(gray, lambda v: hit(v).cast("double"))), F.lit(0.0))
    return share(lambda v: v >= 246) > clip, share(lambda v: v < 10) > clip


def contrast(gray: Column) -> Column:
    """Population standard deviation over 128, at most 1; 0 without pixels."""
    x = F.transform(gray, lambda v: v.cast("double"))
    mean = _mean(x)
    square = _mean(F.transform(x, lambda v: v * v))
    return F.coalesce(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)) / 128), F.lit(0.0))


def saturation(rgb: Column) -> Column:
    """Mean HSV saturation of pixels with r, g, b; 0 without pixels."""
    one = lambda p: F.when(F.greatest(p["r"], p["g"], p["b"]) > 0, (F.greatest(p["r"], p["g"], p["b"]) - F.least(p["r"], p["g"], p["b"])) / F.greatest(p["r"], p["g"], p["b"]).cast("double")).otherwise(F.lit(0.0))
    return F.coalesce(_mean(F.transform(rgb, one)), F.lit(0.0))


def aesthetic(contrast_: Column, saturation_: Column) -> Column:
    """From 0 to 10: half contrast, half saturation."""
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 * (0.5 * contrast_ + 0.5 * saturation_)))


def resized(width: Column, height: Column, side: int, least: int = 3) -> tuple[Column, Column]:
    """Size with ``side`` pixels on the longer side, ``least`` on the shorter at least."""
    longest = F.greatest(width, height)
    one = lambda x: F.greatest(F.round(x * side / longest).cast("long"), F.lit(least).cast("long"))
    return one(width), one(height)


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((2126 * r + 7152 * g + 722 * b) / 10000)
