"""Measures of small rasters with known results, as columns and as numpy on whole pictures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.functions import images, raster


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(expression.alias("x")).first()["x"]


def gray(spark, pixels, width, height):
    df = spark.createDataFrame([([int(p) for p in pixels], width, height)], "gray array<int>, width int, height int")
    over, under = raster.exposure(F.col("gray"), 0.3)
    return df.select(raster.laplacian_variance(F.col("gray"), F.col("width"), F.col("height")).alias("sharp"), over.alias("over"), under.alias("under"), raster.contrast(F.col("gray")).alias("contrast")).first()


def test_uniform_gray_is_flat(spark):
    r = gray(spark, [128] * 400, 20, 20)
    assert r.sharp < 1 and r.contrast < 0.01 and not r.over and not r.under


def test_checkerboard_is_sharp(spark):
    board = [255 * ((x + y) % 2) for y in range(8) for x in range(8)]
    assert gray(spark, board, 8, 8).sharp == pytest.approx(1040400.0)


def test_white_is_over_and_black_is_under(spark):
    white, black = gray(spark, [255] * 100, 10, 10), gray(spark, [0] * 100, 10, 10)
    assert (white.over, white.under) == (True, False)
    assert (black.over, black.under) == (False, True)


def test_no_pixels(spark):
    r = gray(spark, [], 0, 0)
    assert (r.sharp, r.over, r.under, r.contrast) == (0, False, False, 0)


@pytest.mark.parametrize("colour, low, high", [((128, 128, 128), 0, 0.01), ((255, 0, 0), 0.9, 1), ((0, 0, 0), 0, 0)])
def test_saturation(spark, colour, low, high):
    df = spark.createDataFrame([([colour] * 25,)], "rgb array<struct<r:int,g:int,b:int>>")
    assert low <= df.select(raster.saturation(F.col("rgb")).alias("x")).first().x <= high


def test_pictures_are_measured_as_columns_do(spark):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (40, 50, 3)).astype(np.uint8)
    sharp, bright, dark, contrast, saturation = images.measure(rgb, 50)
    g = images.gray_of(rgb)
    df = spark.createDataFrame([(g.ravel().tolist(), 50, 40, [tuple(map(int, p)) for p in rgb.reshape(-1, 3)])], "gray array<int>, width int, height int, rgb array<struct<r:int,g:int,b:int>>")
    r = df.select(raster.laplacian_variance(F.col("gray"), F.col("width"), F.col("height")).alias("sharp"), raster.contrast(F.col("gray")).alias("contrast"), raster.saturation(F.col("rgb")).alias("saturation")).first()
    assert sharp == pytest.approx(r.sharp, rel=1e-9)
    assert contrast == pytest.approx(r.contrast, rel=1e-9)
    assert saturation == pytest.approx(r.saturation, rel=1e-9)
    assert bright == (g >= 246).mean() and dark == (g < 10).mean()


def test_resizing_keeps_flat_pictures_flat():
    flat = np.full((30, 70, 3), 77, np.uint8)
    assert (images.smooth(flat, 11, 23) == 77).all()
    assert images.fitted(4000, 3000, 300) == (300, 225)
    assert images.fitted(40, 30, 300) == (40, 30)
    assert images.nearest(flat[:, :, 0], 300, 500).shape == (300, 500)
