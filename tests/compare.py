"""Rows of two results in a form in which they can be compared."""

import math


def _plain(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return f"b{bool(v)}"
    if isinstance(v, str):
        return f"s{v}"
    return f"n{float(v):.6g}"


def rows(frame) -> list:
    columns = sorted(frame.columns)
    return sorted(tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def same(result, expected) -> None:
    assert sorted(result.columns) == sorted(expected.columns)
    a, b = rows(result), rows(expected)
    assert len(a) == len(b)
    assert [p for p in zip(a, b) if p[0] != p[1]][:3] == []
