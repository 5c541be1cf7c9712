"""State kept by key over a stream: changes of a grade, keys that fall idle, and rows that follow others."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PULSES = "path string, before string, grade string, version long"
HELD = "grade string, version long"


def grade_pulses(updates: DataFrame, keep_seconds: int | None = None) -> DataFrame:
    """A row whenever a photo's grade differs from the one before; its first grade is no change.

    ``updates`` is a stream of ``path, grade, version``. The rows of a key are taken by version within
    a batch, and a version that is not newer than the one held is left out. A photo of which nothing came
    for ``keep_seconds`` is forgotten, and its next grade is a first one; without it all are kept. With it
    the query must run for ever or for one batch, as clocks go on where no more rows come.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["version", "grade"])
        out = []
        for grade, version in zip(rows["grade"], rows["version"]):
            if last is not None and version <= last:
                continue
            if last is not None and grade != held:
                out.append((key[0], held, grade, int(version)))
            held, last = grade, int(version)
        state.update((held, last))
        if keep_seconds is not None:
            state.setTimeoutDuration(keep_seconds * 1000)
        yield pd.DataFrame(out, columns=["path", "before", "grade", "version"])

    timer = "NoTimeout" if keep_seconds is None else "ProcessingTimeTimeout"
    return updates.groupBy("path").applyInPandasWithState(follow, PULSES, HELD, "append", timer)


def idle_keys(events: DataFrame, key: str, time: str, idle_seconds: int, late: str) -> DataFrame:
    """``key, last, n``: a row when the watermark passes ``idle_seconds`` behind a key's last event.

    Then the key's state is gone, and a later event begins anew. Events may come ``late``; older ones
    are left out. The order in which a key's events come makes no difference. Null keys and times are
    left out. State holds one row for each key that is not idle.
    """
    kind = events.schema[key].dataType.simpleString()

    def watch(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [group[0]], "last": [pd.Timestamp(last, unit="us")], "n": [n]})
            return
        last, n = state.get if state.exists else (None, 0)
        for batch in batches:
            newest = int(batch["micros"].max())
            last, n = newest if last is None else max(last, newest), n + len(batch)
        # a timer must lie behind the watermark; one that is due by now rings with the next batch
        due = max(last // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs()) + 1
        state.update((last, n))
        state.setTimeoutTimestamp(due)

    timed = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    rows = timed.select(key, time, F.unix_micros(time).alias("micros"))
    return rows.groupBy(key).applyInPandasWithState(watch, f"{key} {kind}, last timestamp, n long", "last long, n long", "append", "EventTimeTimeout")


def followed_by(first: DataFrame, then: DataFrame, key: str, time: str, within_seconds: int, late: str) -> DataFrame:
    """Pairs of rows of two streams with one ``key`` of which the second is up to ``within_seconds`` behind the first.

    Columns of ``first``, then those of ``then`` but the key, its time as ``then_<time>``; other names must
    differ. Rows may come ``late`` on either side. Both watermarks bound what is kept: a row goes when no
    row that may still come can meet it. Null keys and times meet nothing.
    """
    left = first.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    right = then.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumnsRenamed({key: "_key", time: f"then_{time}"}).withWatermark(f"then_{time}", late)
    soon = (F.col(f"then_{time}") >= F.col(time)) & (F.col(f"then_{time}") <= F.col(time) + F.expr(f"interval {within_seconds} seconds"))
    return left.join(right, (F.col(key) == F.col("_key")) & soon).drop("_key")
