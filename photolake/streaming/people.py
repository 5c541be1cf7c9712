"""People of a stream of faces: each batch is added to the grouping that is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from photolake.operators import incremental
from photolake.sources.projects import Store


def grouped_stream(faces: DataFrame, store: Store, name: str, eps: float, least: int, checkpoint: str, told: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Group a stream of ``ord, embedding`` and keep the grouping as ``name`` in ``store``.

    ``told`` gets each batch's number and all labels after it. A batch that is run again after a failure
    finds its vectors known, so each counts once. The query ends when all there is has been read.
    """

    def add(batch: DataFrame, number: int) -> None:
        grouping = incremental.added(incremental.load(store, name, eps, least), batch)
        incremental.save(grouping, store, name)
        if told:
            told(number, incremental.labels(grouping))

    return faces.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
