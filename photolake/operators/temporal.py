"""Joins by time: the last row before, rows near in time, intervals that overlap, and how many do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photolake.storage import materialize

#: Steps of a second, in which lengths of time are reckoned.
STEP = 1_000_000


def micros(time: Column) -> Column:
    """A timestamp, with or without a zone, as microseconds; the latter as if it were UTC."""
    return F.unix_micros(F.to_timestamp(F.concat(F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z"))))


def as_of(left: DataFrame, right: DataFrame, time: str, by: str, ties: str, tolerance: float | None = None, equal: bool = True) -> DataFrame:
    """Rows of ``left`` with ``matched``, the last row of ``right`` with the same ``by`` and not after its ``time``.

    ``matched`` is a struct of the right row's columns, null where there is none. Of right rows at one
    time the one with the greatest ``ties`` is the last. With ``equal`` false a right row has to be
    earlier; with a ``tolerance`` in seconds it may not be further back. Left rows with a null key or
    time stay without a match, right ones are matched with nothing; repeated rows are rows of their own.

    Rows of both sides are dealt by ranges of key and time, so a busy key is many ranges. Within a range
    the last right row is carried on by a window; what the ranges before have left for a key's first
    rows comes from one row for each range and key.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = F.struct(*right.columns)
    none = F.lit(None).cast(right.select(side.alias("m")).schema["m"].dataType)
    first, last = (0, 1) if equal else (1, 0)
    tie = F.col(ties)
    mine = left.select(F.col(by).alias("_by"), F.col(time).alias("_time"), F.lit(last).alias("_kind"), F.lit(None).cast(right.schema[ties].dataType).alias("_tie"), none.alias("_right"), F.struct(*left.columns).alias("_left"))
    theirs = right.where(F.col(by).isNotNull() & F.col(time).isNotNull()).select(F.col(by).alias("_by"), F.col(time).alias("_time"), F.lit(first).alias("_kind"), tie.alias("_tie"), side.alias("_right"), F.lit(None).cast(mine.schema["_left"].dataType).alias("_left"))
    order = ("_by", "_time", "_kind", "_tie")
    dealt = materialize(mine.unionAll(theirs).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "timed")
    upto = Window.partitionBy("_range", "_by").orderBy("_time", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = dealt.withColumn("_found", F.last("_right", ignorenulls=True).over(upto))
    # a row for each range and key
    left_over = dealt.where("_right is not null").groupBy("_range", "_by").agg(F.max_by("_right", F.struct("_time", "_tie")).alias("_after"))
    spans = dealt.select("_range", "_by").distinct().join(left_over, ["_range", "_by"], "left")
    before = Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    known = spans.withColumn("_before", F.last("_after", ignorenulls=True).over(before)).where("_before is not null").select("_range", "_by", "_before")
    found = carried.where("_left is not null").join(known, ["_range", "_by"], "left").withColumn("_match", F.coalesce("_found", "_before"))
    usable = F.col("_by").isNotNull() & F.col("_time").isNotNull()
    if tolerance is not None:
        usable &= micros(F.col("_time")) - micros(F.col("_match")[time]) <= round(tolerance * STEP)
    return found.select("_left.*", F.when(usable, F.col("_match")).alias("matched"))


def near_in_time(left: DataFrame, right: DataFrame, time: str, by: str, before: float, after: float) -> DataFrame:
    """``l, r``: pairs of rows, as structs, with the same ``by`` of which the right one lies from ``before`` seconds before to ``after`` behind the left.

    Time is cut into cells as long as the window, so each left row looks into two of them, and a row of
    the right side stands in one. Null keys and times pair with nothing.
    """
    width = max(1, round((before + after) * STEP))
    a, b = (df.where(F.col(by).isNotNull() & F.col(time).isNotNull()).select(F.struct(*df.columns).alias(n), F.col(by).alias("_by"), micros(F.col(time)).alias(f"_{n}")) for df, n in ((left, "l"), (right, "r")))
    low, high = F.col("_l") - round(before * STEP), F.col("_l") + round(after * STEP)
    a = a.withColumn("_cell", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    b = b.withColumn("_cell", F.floor(F.col("_r") / width))
    return a.join(b, ["_by", "_cell"]).where((F.col("_r") >= low) & (F.col("_r") <= high)).select("l", "r")


def overlapping(left: DataFrame, right: DataFrame, start: str, end: str, by: str | None = None) -> DataFrame:
    """``l, r``: pairs of rows, as structs, whose intervals from ``start`` to ``end``, both included, share a time.

    An interval of whatever length stands in two cells at most of a grid as wide as itself, and of each
    wider grid that is in use; two intervals meet in the grid of the longer one, in the cell where the
    later of them begins. Intervals that end before they start, and null times or keys, pair with nothing.
    """

    def cells(df: DataFrame, name: str) -> DataFrame:
        key = F.col(by) if by else F.lit(0)
        rows = df.select(F.struct(*df.columns).alias(name), key.alias("_by"), micros(F.col(start)).alias(f"_{name}0"), micros(F.col(end)).alias(f"_{name}1"))
        rows = rows.where(F.col("_by").isNotNull() & (F.col(f"_{name}0") <= F.col(f"_{name}1")))
        # the number of bits of the length; a grid of that level is wider than the interval
        return rows.withColumn(f"_{name}n", F.length(F.bin(F.col(f"_{name}1") - F.col(f"_{name}0"))))

    a, b = cells(left, "l"), cells(right, "r")
    # a row for each level in use, 64 at most
    levels = a.select(F.col("_ln").alias("n")).union(b.select(F.col("_rn").alias("n"))).distinct()
    used = F.lit(sorted(r["n"] for r in levels.collect()) or [0])

    def spread(df: DataFrame, name: str) -> DataFrame:
        out = df.withColumn("_level", F.explode(F.filter(used, lambda n: n >= F.col(f"_{name}n"))))
        at = lambda c: F.expr(f"shiftright(_{name}{c}, _level)")
        return out.withColumn("_cell", F.explode(F.sequence(at(0), at(1))))

    met = spread(a, "l").join(spread(b, "r"), ["_by", "_level", "_cell"])
    later = F.greatest("_l0", "_r0")
    met = met.where((F.col("_level") == F.greatest("_ln", "_rn")) & (later <= F.least("_l1", "_r1")))
    return met.where(F.col("_cell") == F.call_function("shiftright", later, F.col("_level"))).select("l", "r")


def _passed(points: DataFrame, *by: str) -> DataFrame:
    """``_id, passed`` of points ``_id, by, _at, _ends``: at an end how many rows have begun till then, that time included; at a begin minus how many have ended before."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # all begins of a time stand before its ends; the id cuts a time that many share
    order = (*by, "_at", "_ends", "_id")
    dealt = materialize(points.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "points")
    kinds = {"begun": F.when(~F.col("_ends"), 1).otherwise(0), "ended": F.when(F.col("_ends"), 1).otherwise(0)}
    upto = Window.partitionBy("_range", *by).orderBy("_at", "_ends", "_id").rowsBetween(Window.unboundedPreceding, 0)
    # a row for each range and key
    counts = dealt.groupBy("_range", *by).agg(*(F.sum(c).alias(f"_{k}") for k, c in kinds.items()))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_range", *by, *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in kinds))
    begun, ended = (F.col(f"_{k}") + F.sum(c).over(upto) for k, c in kinds.items())
    return dealt.join(bases, ["_range", *by]).select("_id", F.when(F.col("_ends"), begun).otherwise(-ended).alias("passed"))


def met_by_others(rows: DataFrame, start: str, end: str, other: str) -> DataFrame:
    """``rows`` with ``met``, the number of rows of another ``other`` whose intervals from ``start`` to ``end``, both included, share a time with theirs.

    It is what counting the pairs of :func:`overlapping` gives, but pairs, which grow with the square of
    the rows, are never made: an interval meets all that begin till its end but for those that end before
    its begin, and of these its own ``other``'s count as well and are taken off. Both numbers are running
    counts over ranges of time, and of ``other`` and time, with one row for each range carried on.
    Intervals that end before they start, and null times or others, meet nothing and are left out;
    repeated rows are rows of their own.
    """
    # ids stay as they are once written
    known = materialize(rows.where(F.col(other).isNotNull() & (F.col(start) <= F.col(end))).withColumn("_id", F.monotonically_increasing_id()), "intervals")
    ends = F.array(*(F.struct(F.col(c).alias("_at"), F.lit(i == 1).alias("_ends")) for i, c in enumerate((start, end))))
    points = known.select("_id", F.col(other).alias("_by"), F.inline(ends))
    all_, own = _passed(points.drop("_by")), _passed(points, "_by")
    met = all_.unionAll(own.select("_id", -F.col("passed"))).groupBy("_id").agg(F.sum("passed").alias("met"))
    return known.join(met, "_id").drop("_id")
