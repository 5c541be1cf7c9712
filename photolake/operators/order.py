"""Places in the order of a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photolake.storage import materialize


def ranked(rows: DataFrame, *by: str, name: str = "place") -> DataFrame:
    """``rows`` with their places, from 0, in the order of the columns ``by``.

    Rows are dealt by ranges of the order; a place is the rank within the range and the number of rows
    in the ranges before it. The ranges come from a sample, so they are written down with the rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row for each range
    bases = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1
    return dealt.withColumn("_within", within).join(bases, "_range").withColumn(name, (F.col("_base") + F.col("_within")).cast("long")).drop("_range", "_base", "_within")


def in_time_order(photos: DataFrame, headers: DataFrame, name: str = "place") -> DataFrame:
    """``photos`` with the columns of their ``headers`` (by ``path``) and their places in the order of the time taken.

    Photos of one time, and those without one, which come last, are in the order of name and path.
    """
    timed = photos.join(headers, "path", "left").withColumn("_last", F.col("taken").isNull())
    return ranked(timed, "_last", "taken", "filename", "path", name=name).drop("_last")
