"""Queries of totals, sketches, failures and keyed state over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.operators import failures, sketches, totals
from photolake.plans import fixtures as X
from photolake.plans.catalog import query
from photolake.plans.views import over
from photolake.storage import materialize, scratch_path
from photolake.streaming import changes


@query(
    over(
        """select grade, grade_source, person, grouping(grade, grade_source, person) as grouping_id, count(distinct path) as photos, count(person) as appearances
        from (select distinct p.path, grade, grade_source, label as person from photos p left join raw_faces f on f.photo_ord = p.photo_ord)
        group by grouping sets ((grade, grade_source, person), (grade, grade_source), (grade), (person), ())""",
        "photos",
        "raw_faces",
    )
)
def grade_totals(spark, sf_dir: str) -> DataFrame:
    """Photos by grade, source and person with all subtotals; a photo of two persons is one in sums over persons."""
    on = X.faces(spark, sf_dir).select("photo_ord", F.col("label").alias("person")).distinct()
    rows = X.photos(spark, sf_dir).join(on, "photo_ord", "left").select("path", "grade", "grade_source", "person")
    sets = [*totals.rollup_sets("grade", "grade_source", "person"), ["person"]]
    return totals.subtotals(rows, ["grade", "grade_source", "person"], sets, photos=F.count_distinct("path"), appearances=F.count("person"))


@query("select l_returnflag, count(*) as n, count(distinct l_partkey) as n_distinct, true as distinct_within, true as median_within, true as tail_within from lineitem group by l_returnflag")
def sketched_lines(spark, sf_dir: str) -> DataFrame:
    """Sketches by month, united by kind of line; whether they are as near to the truth as they promise."""
    rows = X.table(spark, sf_dir, "lineitem").select("l_returnflag", F.date_trunc("month", "l_shipdate").alias("month"), "l_partkey", "l_extendedprice")
    parts = sketches.sketched(rows, "l_partkey", "l_extendedprice", "l_returnflag", "month")
    told = materialize(sketches.read(sketches.united(parts, "l_returnflag"), 0.5, 0.95), "told").withColumnsRenamed({"n_distinct": "told_distinct", "n": "told_n"})
    # a handful of kinds, each of one row
    both = rows.join(F.broadcast(told), "l_returnflag")
    held = both.groupBy("l_returnflag", "told_distinct", "told_n", "quantiles").agg(
        F.count("*").alias("n"),
        F.count_distinct("l_partkey").alias("n_distinct"),
        *((F.count_if(F.col("l_extendedprice") <= F.get("quantiles", F.lit(i))) / F.count("*")).alias(f"at_{i}") for i in range(2)),
        *((F.count_if(F.col("l_extendedprice") < F.get("quantiles", F.lit(i))) / F.count("*")).alias(f"below_{i}") for i in range(2)),
    )
    # a value that many rows hold has a range of ranks
    near = lambda i, share: (F.col(f"below_{i}") <= share + sketches.RANK_ERROR) & (F.col(f"at_{i}") >= share - sketches.RANK_ERROR)
    return held.select(
        "l_returnflag",
        "n",
        "n_distinct",
        ((F.abs(F.col("told_distinct") - F.col("n_distinct")) <= F.col("n_distinct") * sketches.DISTINCT_ERROR) & (F.col("told_n") == F.col("n"))).alias("distinct_within"),
        near(0, 0.5).alias("median_within"),
        near(1, 0.95).alias("tail_within"),
    )


@query(
    """with log as (select user_id, event_id, epoch_us(ts) as moment, event_type from events where event_type in ('error', 'purchase')),
    since as (select l.* from log l left join (select user_id, max(moment) as well from log where event_type = 'purchase' group by user_id) w on w.user_id = l.user_id
      where l.event_type = 'error' and (w.well is null or l.moment > w.well)),
    found as (select user_id, count(distinct moment) as attempts, max(moment) as last, arg_max('Event ' || event_id, moment) as error from since group by user_id)
    select user_id, error, attempts, last, case when attempts < 4 then last + least(3600000000 * (1 << (attempts - 1)::int), 10000000000)::bigint end as next_at from found"""
)
def still_failing(spark, sf_dir: str) -> DataFrame:
    """Users whose errors no purchase followed: how many, and when the next attempt is due."""
    e = X.table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')")
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("Event "), F.col("event_id")))
    log = e.select("user_id", error.alias("error"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return failures.still_failing(log, "user_id", wait=3_600_000_000, longest=10_000_000_000, most=4)


def _streamed(spark, sf_dir: str) -> DataFrame:
    """The events as a stream of all that is there, in one batch."""
    schema = X.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _written(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream until all has been read, and read its rows back."""
    spark, out = stream.sparkSession, scratch_path(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query(
    """select l.event_id as a, r.event_id as b from events l join events r on r.user_id = l.user_id and r.ts between l.ts and l.ts + interval 30 minute
    where l.event_type = 'view' and r.event_type = 'purchase'"""
)
def views_then_purchases(spark, sf_dir: str) -> DataFrame:
    """Two streams joined: a user's purchases at most half an hour behind a view."""
    viewed = _streamed(spark, sf_dir).where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("a"))
    bought = _streamed(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("b"))
    return _written(changes.followed_by(viewed, bought, "user_id", "ts", 1800, "1 hour"), "followed").select("a", "b")


@query(
    """select user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last, count(*) as n from events group by user_id
    having epoch_ms(max(ts)) + 5400000 < (select epoch_ms(max(ts)) - 600000 from events)"""
)
def idle_users(spark, sf_dir: str) -> DataFrame:
    """Users from whom nothing came for an hour and a half before the end of the stream, found by timers."""
    found = changes.idle_keys(_streamed(spark, sf_dir), "user_id", "ts", 5400, "10 minutes")
    return _written(found, "idle").select("user_id", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "n")
