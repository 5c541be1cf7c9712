"""Queries over the event table: changes of state, windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions import exif
from photolake.operators import events, order, temporal, views
from photolake.plans import fixtures as X
from photolake.plans.catalog import query
from photolake.storage import materialize


def _time(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("select user_id, event_id, before, event_type from (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before <> event_type")
def grade_changes(spark, sf_dir: str) -> DataFrame:
    """Events whose kind differs from the user's event before."""
    e = X.table(spark, sf_dir, "events")
    return views.changed_values(e, "user_id", "event_type", "ts", "event_id").select("user_id", "event_id", "before", "event_type")


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by date_trunc('hour', ts), event_type")
def events_window(spark, sf_dir: str) -> DataFrame:
    found = events.windowed(X.table(spark, sf_dir, "events"), "1 hour", "event_type")
    return found.select(_time("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last, count(*) as n from (
      select *, sum(fresh) over (partition by user_id order by ts, event_id) as run from (
        select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 2 hour then 0 else 1 end as fresh from events))
    group by user_id, run"""
)
def events_session(spark, sf_dir: str) -> DataFrame:
    found = events.sessions(X.table(spark, sf_dir, "events"), "2 hours", "user_id")
    return found.select("user_id", _time("start"), _time("last"), "n")


SESSIONS_SQL = """sessions as (select user_id, min(ts) as first, max(ts) as last from (
      select *, sum(fresh) over (partition by user_id order by ts, event_id) as run from (
        select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 2 hour then 0 else 1 end as fresh from events)) group by user_id, run)"""


@query(
    """select l.event_id, r.event_id as matched_id, r.event_type as matched_type from (select * from events where event_type = 'purchase') l
    left join events r on r.user_id = l.user_id and r.event_type <> 'purchase' and r.ts <= l.ts
    qualify row_number() over (partition by l.event_id order by r.ts desc nulls last, r.event_id desc) = 1"""
)
def last_before_purchase(spark, sf_dir: str) -> DataFrame:
    """The user's last event of another kind before each purchase."""
    e = X.table(spark, sf_dir, "events")
    found = temporal.as_of(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'"), "ts", "user_id", "event_id")
    return found.select("event_id", F.col("matched.event_id").alias("matched_id"), F.col("matched.event_type").alias("matched_type"))


@query(
    """select l.event_id, case when l.ts - r.ts <= interval 3 hour then r.event_id end as matched_id from events l
    left join events r on r.user_id = l.user_id and r.ts < l.ts
    qualify row_number() over (partition by l.event_id order by r.ts desc nulls last, r.event_id desc) = 1"""
)
def previous_within_hours(spark, sf_dir: str) -> DataFrame:
    """Each event with the user's event strictly before it, if that is three hours back at most."""
    e = X.table(spark, sf_dir, "events")
    found = temporal.as_of(e, e, "ts", "user_id", "event_id", tolerance=3 * 3600, equal=False)
    return found.select("event_id", F.col("matched.event_id").alias("matched_id"))


@query("select l.event_id as a, r.event_id as b from events l join events r on r.user_id = l.user_id and r.event_id <> l.event_id and r.ts between l.ts - interval 10 minute and l.ts + interval 30 minute")
def events_near_in_time(spark, sf_dir: str) -> DataFrame:
    """Pairs of a user's events of which the second is from 10 minutes before to 30 behind the first."""
    e = X.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = temporal.near_in_time(e, e, "ts", "user_id", 600, 1800)
    return found.select(F.col("l.event_id").alias("a"), F.col("r.event_id").alias("b")).where("a <> b")


@query(f"with {SESSIONS_SQL} select a.user_id, strftime(a.first, '%Y-%m-%d %H:%M:%S') as first, count(*) as met from sessions a join sessions b on b.user_id <> a.user_id and b.first <= a.last and a.first <= b.last group by a.user_id, a.first")
def overlapping_sessions(spark, sf_dir: str) -> DataFrame:
    """With how many sessions of others each session overlaps, of those that meet any."""
    s = events.sessions(X.table(spark, sf_dir, "events"), "2 hours", "user_id").select("user_id", F.col("start").alias("first"), "last")
    found = temporal.met_by_others(s, "first", "last", "user_id").where("met > 0")
    return found.select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "met")


@query(
    """select event_id, case when event_id % 11 <> 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') end as taken, case when event_id % 11 <> 0 then (user_id % 8 + 1)::int end as orientation,
    row_number() over (order by event_id % 11 = 0, case when event_id % 11 <> 0 then date_trunc('second', ts) end, event_id) - 1 as place from events"""
)
def header_times(spark, sf_dir: str) -> DataFrame:
    """Events as headers of pictures, in both orders of bytes and some cut off, read again and put in the order of time."""
    odd, text = F.col("event_id") % 2 == 1, F.encode(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), "US-ASCII")
    turn = F.lpad(F.hex(F.col("user_id") % 8 + 1), 2, "0")
    small = F.concat(F.lit("49492A0008000000" "0200" "1201" "0300" "01000000"), turn, F.lit("000000" "3201" "0200" "14000000" "26000000" "00000000"))
    big = F.concat(F.lit("4D4D002A00000008" "0002" "0112" "0003" "00000001" "00"), turn, F.lit("0000" "0132" "0002" "00000014" "00000026" "00000000"))
    data = F.concat(F.unhex(F.when(odd, big).otherwise(small)), text, F.unhex(F.lit("00")))
    cut = F.when(F.col("event_id") % 11 == 0, F.substring(data, 1, 7)).otherwise(data)
    files = X.table(spark, sf_dir, "events").select("event_id", cut.alias("content"))
    # headers are read once, whatever the ranges of their order take to be drawn
    found = materialize(exif.headers(files, "event_id", F.col("content"), 4096).select("event_id", "taken", "orientation"), "headers")
    found = order.ranked(found.withColumn("lost", F.col("taken").isNull()), "lost", "taken", "event_id")
    return found.select("event_id", F.date_format("taken", "yyyy-MM-dd HH:mm:ss").alias("taken"), "orientation", "place")
