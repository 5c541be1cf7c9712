"""Boxes, anchors and similarity transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes with x1, y1, x2, y2, in double precision."""
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = width * height
    return both / (area(a) + area(b) - both + F.lit(1e-6))


def clip(x: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, high))


def letterbox(width: Column, height: Column, side: int) -> dict[str, Column]:
    """Scale, size and padding of an image that is fitted into a square."""
    scale = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    new_width, new_height = F.floor(width * scale), F.floor(height * scale)
    return {"scale": scale, "new_width": new_width, "new_height": new_height, "pad_x": F.floor((F.lit(side) - new_width) / 2), "pad_y": F.floor((F.lit(side) - new_height) / 2)}


def unletterbox(v: Column, pad: Column, scale: Column) -> Column:
    return (v - pad) / scale


def anchor(index: Column, cells: Column, stride: Column, per_cell: int = 2) -> tuple[Column, Column]:
    """Centre of the anchor at a flat index of a ``cells`` wide map with ``per_cell`` anchors a cell."""
    cell = F.floor(index / per_cell)
    return (cell % cells + 0.5) * stride, (F.floor(cell / cells) + 0.5) * stride


def box_of(cx: Column, cy: Column, stride: Column, left: Column, top: Column, right: Column, bottom: Column) -> dict[str, Column]:
    """A box from distances, in strides, to the four sides."""
    return {"x1": cx - left * stride, "y1": cy - top * stride, "x2": cx + right * stride, "y2": cy + bottom * stride}


def similarity(n: Column, sx: Column, sy: Column, su: Column, sv: Column, sxu: Column, syv: Column, sxv: Column, syu: Column, sq: Column) -> dict[str, Column]:
    """Least-squares turn, scale and shift of points (x, y) onto (u, v) from sums over the points.

    u = a x - b y + tx and v = b x + a y + ty. ``sq`` is the sum of x*x + y*y. Null where the points
    fall together.
    """
    det = sq - (sx * sx + sy * sy) / n
    a = (sxu + syv - (sx * su + sy * sv) / n) / F.nullif(det, F.lit(0.0))
    b = (sxv - syu - (sx * sv - sy * su) / n) / F.nullif(det, F.lit(0.0))
    return {"a": a, "b": b, "tx": (su - a * sx + b * sy) / n, "ty": (sv - b * sx - a * sy) / n}


def inverse_similarity(a: Column, b: Column, tx: Column, ty: Column) -> dict[str, Column]:
    size = F.nullif(a * a + b * b, F.lit(0.0))
    ia, ib = a / size, -b / size
    return {"ia": ia, "ib": ib, "itx": -(ia * tx - ib * ty), "ity": -(ib * tx + ia * ty)}
