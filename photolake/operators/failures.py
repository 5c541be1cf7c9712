"""What failed, how often, and when it is tried again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def still_failing(log: DataFrame, *keys: str, wait: int, longest: int, most: int) -> DataFrame:
    """``keys, error, attempts, last, next_at`` of what has failed since it last went well.

    ``log`` has ``error`` (null: it went well) and ``at``, a whole number. The first attempt is repeated
    ``wait`` behind the failure, each further one after twice the time, ``longest`` at most; behind ``most``
    attempts ``next_at`` is null and none follows. Rows written twice at one time are one attempt, a
    failure at the time of a success is mended, and of several errors at the last time the largest text
    stands. Rows without ``at`` or with a null key are left out. Both sides are summed up by key before
    they are joined but for the failures themselves, which are joined with one time for each key.
    """
    dated = log.where(F.col("at").isNotNull()).select(*keys, "error", "at")
    well = dated.where("error is null").groupBy(*keys).agg(F.max("at").alias("_well"))
    # one row for each attempt, so that a key's long log is summed up where it lies
    failed = dated.where("error is not null").dropna(subset=list(keys)).groupBy(*keys, "at").agg(F.max("error").alias("error"))
    since = failed.join(well, list(keys), "left").where(F.col("_well").isNull() | (F.col("at") > F.col("_well")))
    found = since.groupBy(*keys).agg(F.max_by("error", "at").alias("error"), F.count("*").alias("attempts"), F.max("at").alias("last"))
    pause = F.least(F.lit(wait) * F.pow(F.lit(2.0), F.col("attempts") - 1), F.lit(longest)).cast("long")
    return found.withColumn("next_at", F.when(F.col("attempts") < most, F.col("last") + pause))


def outcomes(tried: DataFrame, errors: DataFrame, log: DataFrame, *keys: str) -> DataFrame:
    """``keys, error`` to be added to ``log``: all that failed of ``tried``, and what had failed before and now did not."""
    worst = errors.where("error is not null").groupBy(*keys).agg(F.max("error").alias("error"))
    both = tried.select(*keys).dropDuplicates().join(worst, list(keys), "left")
    before = log.select(*keys).dropDuplicates().withColumn("_before", F.lit(True))
    return both.join(before, list(keys), "left").where("error is not null or _before").select(*keys, "error")
