"""Numbers of distinct values and quantiles from sketches that are kept by part and united."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Within these the true values lie with a probability of more than 0.99: a share of the distinct number
#: at 2^12 registers (three standard errors of 1.04 / 64), and of the ranks at ``K``.
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.0175
LG_REGISTERS, K = 12, 400


def sketched(rows: DataFrame, distinct: str, measured: str, *by: str) -> DataFrame:
    """``by, n, distinct_sketch, quantile_sketch``: a row of a few kilobytes for each part.

    Nulls count in ``n`` alone. Sketches are filled where rows lie and merged behind the shuffle.
    """
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(distinct, F.lit(LG_REGISTERS)).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(measured).cast("double"), F.lit(K)).alias("quantile_sketch")
    )


def united(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of unions; which parts are united first makes no difference beyond the errors stated."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch", F.lit(K)).alias("quantile_sketch"))


def read(sketches: DataFrame, *shares: float) -> DataFrame:
    """The sketches' columns replaced by ``n_distinct`` and ``quantiles``, one for each of ``shares``; null of no values."""
    known = F.kll_sketch_get_n_double("quantile_sketch") > 0
    # one share after the other, as the function takes a constant
    found = F.array(*(F.when(known, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(s)))) for s in shares))
    kept = [c for c in sketches.columns if c not in ("distinct_sketch", "quantile_sketch")]
    return sketches.select(*kept, F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), found.alias("quantiles"))


def refreshed(rows: DataFrame, kept: DataFrame, key: str, distinct: str, measured: str, parts: int) -> DataFrame:
    """``part, mark, n, distinct_sketch, quantile_sketch`` as they are now, where only changed parts are sketched.

    A sketch cannot forget a row, so rows are dealt to ``parts`` by a hash of ``key``; a part whose mark
    (an order-free sum over its rows' hashes) is that of ``kept`` keeps its sketches.
    """
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.xxhash64(key, distinct, measured).alias("_hash"), distinct, measured)
    marks = dealt.groupBy("part").agg(F.sum(F.col("_hash").cast("decimal(38,0)")).alias("mark"))
    same = kept.join(marks, ["part", "mark"], "left_semi")
    stale = marks.join(same.select("part"), "part", "left_anti")
    fresh = sketched(dealt.join(stale.select("part"), "part", "left_semi"), distinct, measured, "part").join(stale, "part")
    names = ["part", "mark", "n", "distinct_sketch", "quantile_sketch"]
    return same.select(*names).unionByName(fresh.select(*names))
