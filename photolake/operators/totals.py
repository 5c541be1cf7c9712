"""Subtotals over several groupings in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subtotals(rows: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]], **measures: Column) -> DataFrame:
    """``by``, ``grouping_id`` and ``measures`` for each of ``sets``, groups of columns out of ``by``.

    A bit of ``grouping_id`` is 1 where a column is summed over (the first of ``by`` has the highest bit),
    which tells such a null from one in the data. The rows are read once, and summed up before the shuffle.
    """
    unknown = {c for s in sets for c in s} - set(by)
    if unknown:
        raise ValueError(f"not among the columns: {sorted(unknown)}")
    found = rows.groupingSets([[F.col(c) for c in s] for s in sets], *by)
    return found.agg(F.grouping_id().alias("grouping_id"), *(m.alias(name) for name, m in measures.items()))


def rollup_sets(*by: str) -> list[list[str]]:
    """All beginnings of ``by``, the whole first and the grand total last."""
    return [list(by[:i]) for i in range(len(by), -1, -1)]
