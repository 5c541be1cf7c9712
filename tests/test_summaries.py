"""Failures with attempts, sketches that are united, subtotals; and what the library makes of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.api import Library
from photolake.config import Config
from photolake.operators import failures, sketches, totals
from photolake.sources.sinks import png

LOG = "k string, error string, at long"


def test_attempts_waits_and_mended_failures(spark):
    rows = [("a", "x", 10), ("a", "y", 20), ("a", "y", 20), ("a", "w", 20), ("b", "x", 10), ("b", None, 11), ("b", "z", 12), ("c", "x", 5), ("c", None, 5), ("d", None, 1), (None, "x", 3), ("e", "x", None)]
    rows += [("f", "x", i) for i in range(5)]
    found = failures.still_failing(spark.createDataFrame(rows, LOG), "k", wait=100, longest=150, most=5)
    assert {r.k: (r.error, r.attempts, r["last"], r.next_at) for r in found.collect()} == {"a": ("y", 2, 20, 170), "b": ("z", 1, 12, 112), "f": ("x", 5, 4, None)}
    assert failures.still_failing(spark.createDataFrame([], LOG), "k", wait=1, longest=1, most=1).isEmpty()


def test_outcomes_hold_failures_and_what_is_mended(spark):
    tried = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "k string")
    errors = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("c", None)], "k string, error string")
    log = spark.createDataFrame([("b", "old", 1), ("z", "old", 1)], LOG)
    assert sorted((r.k, r.error) for r in failures.outcomes(tried, errors, log, "k").collect()) == [("a", "y"), ("b", None)]


def test_sketches_united_in_any_order_stay_within_their_errors(spark):
    n = 60_000
    rows = spark.range(n).select((F.col("id") % 7).alias("part"), (F.col("id") % 20_000).alias("v"), (F.col("id") * 7919 % n).cast("double").alias("m"))
    parts = sketches.sketched(rows, "v", "m", "part")
    ways = [parts.where("part < 3"), parts.where("part >= 3")], [parts.where("part % 2 = 1"), parts.where("part % 2 = 0")]
    for a, b in ways:
        got = sketches.read(sketches.united(sketches.united(b).unionByName(sketches.united(a))), 0.1, 0.5, 0.9).first()
        assert got.n == n and abs(got.n_distinct / 20_000 - 1) < sketches.DISTINCT_ERROR
        assert np.abs(np.array(got.quantiles) / n - [0.1, 0.5, 0.9]).max() < sketches.RANK_ERROR


def test_sketches_of_nothing_and_of_nulls(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", 1, 2.0), ("b", 1, None)], "part string, v int, m double")
    got = {r.part: (r.n, r.n_distinct, r.quantiles) for r in sketches.read(sketches.sketched(rows, "v", "m", "part"), 0.5).collect()}
    assert got == {"a": (1, 0, [None]), "b": (2, 1, [2.0])}
    assert sketches.sketched(rows.limit(0), "v", "m", "part").isEmpty()


def test_only_changed_parts_are_sketched_anew(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 10).alias("v"), F.col("id").cast("double").alias("m"))
    kept = sketches.refreshed(rows, sketches.refreshed(rows, spark.createDataFrame([], "part int, mark decimal(38,0), n long, distinct_sketch binary, quantile_sketch binary"), "id", "v", "m", 8), "id", "v", "m", 8)
    # a kept sketch is told by a number that no row count has
    kept = spark.createDataFrame(kept.withColumn("n", -F.col("n")).collect(), kept.schema)
    more = rows.unionByName(spark.createDataFrame([(5000, 99, 1.0)], rows.schema))
    now = sketches.refreshed(more, kept, "id", "v", "m", 8)
    fresh = now.where("n > 0").collect()
    assert now.count() == 8 and len(fresh) == 1 and now.where("n < 0").count() == 7
    # a row that is gone changes its part too
    assert sketches.refreshed(rows.where("id <> 3"), kept, "id", "v", "m", 8).where("n > 0").count() == 1


def test_subtotals_tell_nulls_of_the_data_from_sums(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 2), (None, 2)], "a string, b int")
    found = totals.subtotals(rows, ["a", "b"], totals.rollup_sets("a", "b"), n=F.count("*"))
    assert sorted((r.grouping_id, r.a or "", r.b or 0, r.n) for r in found.collect()) == [(0, "", 2, 1), (0, "x", 1, 1), (0, "x", 2, 1), (1, "", 0, 1), (1, "x", 0, 2), (3, "", 0, 3)]
    with pytest.raises(ValueError):
        totals.subtotals(rows, ["a"], [["b"]], n=F.count("*"))


def test_a_broken_picture_is_told_and_tried_again(spark, tmp_path):
    folder = tmp_path / "pictures"
    folder.mkdir()
    noise = np.random.default_rng(0).integers(0, 255, (40, 40, 3), np.uint8)
    (folder / "good.png").write_bytes(png(noise))
    (folder / "broken.png").write_bytes(b"no picture")
    library = Library(spark, f"file://{tmp_path}/library", Config(retry_seconds=100, retry_attempts=2))
    project = library.import_folder(str(folder))
    library.start_enrichment(project, now=5)
    told = library.failures(project).collect()
    assert [(r.path.rsplit("/", 1)[1], r.stage, r.attempts, r["last"], r.next_at) for r in told] == [("broken.png", "grading", 1, 5, 105)] and told[0].error.startswith("Image error: ")
    library.start_enrichment(project, now=104)
    assert library.failures(project).first().attempts == 1
    library.start_enrichment(project, now=105)
    again = library.failures(project).first()
    assert (again.attempts, again["last"], again.next_at) == (2, 105, None)
    graded = {r.filename: r.graded_at for r in library.photos(project).collect()}
    assert graded == {"good.png": 5, "broken.png": 105}
    # a file that was mended begins anew
    (folder / "broken.png").write_bytes(png(noise[:20]))
    library.open_project(project)
    library.start_enrichment(project, now=106)
    assert library.failures(project).isEmpty()
    stats = library.statistics(project, 0.5).first()
    assert (stats.n, stats.n_distinct) == (2, 2) and stats.quantiles[0] > 0
    sums = {r.grouping_id: r.photos for r in library.grade_totals(project).where("grade is null").collect()}
    assert sums[7] == 2


def test_a_model_that_fails_leaves_a_trace(spark, tmp_path):
    from tests.test_media import onnx_file

    folder = tmp_path / "pictures"
    folder.mkdir()
    (folder / "a.png").write_bytes(png(np.random.default_rng(1).integers(0, 255, (40, 40, 3), np.uint8)))
    # neither has the outputs of a detector
    files = tuple(onnx_file(tmp_path / f"{n}.onnx", 640) for n in ("detect", "embed"))
    library = Library(spark, f"file://{tmp_path}/library", Config(retry_seconds=100), files)
    project = library.import_folder(str(folder))
    library.start_enrichment(project, now=5)
    told = library.failures(project).collect()
    assert [(r.stage, r.attempts, r.next_at) for r in told] == [("faces", 1, 105)] and told[0].error.startswith("Inference error: ")
    library.start_enrichment(project, now=105)
    row = library.photos(project).first()
    assert (library.failures(project).first().attempts, row.graded_at, row.faces_detected_at) == (2, 5, 105)
