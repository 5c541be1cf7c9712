"""Streams: resumed ingestion, grade changes, windows, progress."""

import json

from pyspark.sql import functions as F

from photolake.config import Config
from photolake.streaming import changes, enrich


def test_ingestion_goes_on_where_it_stopped(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    for i in range(7):
        (folder / f"{i}.jpg").write_bytes(b"x" * (i + 1))
    (folder / "a.txt").write_text("no")
    stream = enrich.photo_stream(spark, str(folder), Config(batch_photos=3))
    enrich.each_batch(stream, out, mark, lambda b: b).awaitTermination()
    assert spark.read.parquet(out).count() == 7
    (folder / "later.png").write_bytes(b"y")
    enrich.each_batch(stream, out, mark, lambda b: b).awaitTermination()
    found = spark.read.parquet(out)
    assert found.count() == 8 and found.select("path").distinct().count() == 8


def test_grade_pulses(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, rows):
        (folder / name).write_text("\n".join(json.dumps(dict(zip(("path", "grade", "version"), r))) for r in rows))

    stream = spark.readStream.schema("path string, grade string, version long").json(str(folder))
    run = lambda: changes.grade_pulses(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    put("1.json", [("a", "Ungraded", 1), ("a", "Good", 2), ("b", "Bad", 1), ("b", "Bad", 3)])
    run()
    put("2.json", [("a", "Bad", 3), ("b", "Ok", 2), ("c", "Ok", 1)])
    run()
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("path", "version").collect()
    assert [(r.path, r.before, r.grade) for r in found] == [("a", "Ungraded", "Good"), ("a", "Good", "Bad")]


def test_windows_over_a_stream_equal_those_over_the_table(spark, sf_dir, tmp_path):
    from photolake.operators.events import windowed

    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = enrich.event_windows(stream, "1 day", "60 days", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("w")) == key(windowed(table.withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "event_type"))


def test_progress_is_reported(spark, tmp_path):
    told = []
    listener = enrich.Progress(lambda stage, done, name: told.append((stage, done)))
    spark.streams.addListener(listener)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.json").write_text('{"x": 1}\n{"x": 2}')
        stream = spark.readStream.schema("x int").json(str(tmp_path / "in"))
        enrich.each_batch(stream, str(tmp_path / "out"), str(tmp_path / "mark"), lambda b: b).awaitTermination()
        import time

        for _ in range(50):
            if told and told[-1][0] == "complete":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told[-1] == ("complete", 2)


def test_a_photo_is_forgotten_after_a_time(spark, tmp_path):
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema("path string, grade string, version long").json(str(folder))

    def run(name, *rows):
        (folder / name).write_text("\n".join(json.dumps(dict(zip(("path", "grade", "version"), r))) for r in rows))
        pulses = changes.grade_pulses(stream, keep_seconds=2)
        pulses.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(once=True).start().awaitTermination()

    run("1.json", ("a", "Ok", 1))
    time.sleep(3)
    run("2.json", ("b", "Ok", 1))  # the timer of a rings with this batch
    run("3.json", ("a", "Bad", 2), ("b", "Bad", 2))
    found = {r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert "a" not in found


def at(minute):
    return f"2024-01-01 00:{minute:02d}:00"


def run_over(spark, tmp_path, name, stream_of, *files):
    """Rows of a stream to which the files of rows come one batch after the other."""
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    for i, rows in enumerate(files):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stream_of().writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-mark")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def test_keys_that_fall_idle_late_rows_and_nulls(spark, tmp_path):
    row = lambda k, m: {"k": k, "ts": at(m)}
    stream = lambda: changes.idle_keys(spark.readStream.schema("k string, ts timestamp").json(str(tmp_path / "in")), "k", "ts", 600, "5 minutes")
    found = run_over(
        spark,
        tmp_path,
        "idle",
        stream,
        [row("a", 3), row("a", 1), row("b", 10), row(None, 2), {"k": "n"}],
        [row("b", 30), row("a", 2)],  # the watermark stands at 5: the second is late
        [row("a", 40), row("b", 41)],  # a begins anew
        [row("b", 59)],
    )
    rows = sorted((r.k, r["last"].minute, r.n) for r in found.collect())
    assert rows == [("a", 3, 2), ("a", 40, 1)]


def test_rows_that_follow_others_within_a_time(spark, tmp_path):
    row = lambda side, k, m, i: {"side": side, "k": k, "ts": at(m), "i": i}

    def stream():
        rows = spark.readStream.schema("side string, k string, ts timestamp, i int").json(str(tmp_path / "in"))
        return changes.followed_by(rows.where("side = 'l'").select("k", "ts", "i"), rows.where("side = 'r'").select("k", "ts", F.col("i").alias("j")), "k", "ts", 600, "10 minutes")

    found = run_over(
        spark,
        tmp_path,
        "pairs",
        stream,
        [row("l", "a", 1, 1), row("r", "b", 2, 2), row("l", None, 1, 9), row("r", None, 1, 9)],
        [row("r", "a", 11, 3), row("r", "a", 12, 4), row("l", "b", 2, 5)],  # ten minutes, eleven, at one time
        [row("l", "c", 59, 6), row("r", "c", 58, 7)],  # the other order is no pair
        [row("r", "a", 5, 8), row("r", "c", 59, 9)],  # the first is late
    )
    assert sorted((r.i, r.j) for r in found.collect()) == [(1, 3), (5, 2), (6, 9)]
